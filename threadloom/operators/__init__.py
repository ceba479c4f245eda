"""DataFrame operators over posts, conversations, codes and statistics."""
