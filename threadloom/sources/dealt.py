"""A post table dealt by conversation, so that rollups and joins on it move no posts.

Conversations go to a fixed number of buckets by the hash of their id, one sorted file each. A
conversation of more than ``large`` posts would make one bucket, and so one task, too long; such
conversations are kept apart, in sorted ranges, and whatever is worked out per conversation is worked
out for both parts by :meth:`Dealt.per_conversation`.

Defined results: posts without a conversation are dealt like those of one conversation. Repeated rows
stay. An empty table has one bucket. A folder whose layout is missing was not written to its end, and
reading it fails.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadloom.session import discard, materialise, read_buckets, write_buckets

CONVERSATION = "conversation_id"
BUCKET_POSTS = 1 << 20
#: Posts beyond which a conversation is kept apart.
LARGE_POSTS = BUCKET_POSTS // 4
_LAYOUT = "buckets int, n_large long"


@dataclass(frozen=True)
class Dealt:
    """A stored post table: ``few`` in buckets, and the conversations that are too ``large`` for one."""

    few: DataFrame
    large: DataFrame
    buckets: int
    #: Conversations kept apart.
    n_large: int

    def posts(self) -> DataFrame:
        return self.few.unionByName(self.large)

    def per_conversation(self, reduce: Callable[[DataFrame, int | None], DataFrame]) -> DataFrame:
        """``reduce`` over all posts, for reductions whose rows come from one conversation each.

        It is given posts and the number of their buckets, none for the conversations kept apart.
        """
        few = reduce(self.few, self.buckets)
        return few.unionByName(reduce(self.large, None)) if self.n_large else few


def write_dealt(posts: DataFrame, path: str, buckets: int | None = None, large: int = LARGE_POSTS) -> None:
    """Write a new table of posts, which are worked out once and written aside meanwhile.

    ``buckets`` defaults to one for every :data:`BUCKET_POSTS` posts. Tables that are to be joined
    without an exchange need the same number.
    """
    spark, posts = posts.sparkSession, materialise(posts, "posts")
    sizes = materialise(posts.groupBy(CONVERSATION).agg(F.count("*").alias("_n")), "sizes")
    apart = sizes.where(F.col("_n") > large)
    total = sizes.agg(F.sum("_n").alias("n"), F.count_if(F.col("_n") > large).alias("n_large")).first()
    buckets = buckets or max(1, -(-(total["n"] or 0) // BUCKET_POSTS))
    kept = materialise(apart.select(F.col(CONVERSATION).alias("_apart")), "apart")
    same = F.col(CONVERSATION).eqNullSafe(F.col("_apart"))
    write_buckets(posts.join(kept, same, "left_anti"), f"{path}/few", CONVERSATION, buckets, ("pid",))
    ranges = posts.join(kept, same, "left_semi").repartitionByRange(CONVERSATION, "pid")
    ranges.sortWithinPartitions(CONVERSATION, "pid").write.parquet(f"{path}/large")
    layout = spark.createDataFrame([(buckets, total["n_large"] or 0)], _LAYOUT)
    discard(posts)
    layout.coalesce(1).write.json(f"{path}/layout")


def read_dealt(spark: SparkSession, path: str, schema: StructType) -> Dealt:
    """The table of :func:`write_dealt`, from any session."""
    layout = spark.read.schema(_LAYOUT).json(f"{path}/layout").first()
    few = read_buckets(spark, f"{path}/few", schema, CONVERSATION, layout["buckets"])
    large = spark.read.schema(schema).parquet(f"{path}/large")
    return Dealt(few, large, layout["buckets"], layout["n_large"])
