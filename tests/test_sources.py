import gzip
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.functions.keywords import Dictionary
from threadloom.operators import posts as post_ops
from threadloom.sources import packed, pages, sinks, survey, tables, threads


def put(path, content, compress=False):
    data = content.encode()
    path.write_bytes(gzip.compress(data) if compress else data)


def post(i, conversation="7", **more):
    return {"id": str(i), "conversation_id": conversation, "text": f"text {i}", "author_id": "u", "created_at": "t", **more}


def test_pages_with_faults(spark, tmp_path):
    whole = {"data": [post(1), {"id": "2"}], "includes": {"tweets": [post(3)]}, "meta": {"result_count": 3}}
    put(tmp_path / "7_0.json.gz", json.dumps(whole), True)
    put(tmp_path / "7_1.json.gz", json.dumps({"data": [post(4)]}), True)
    put(tmp_path / "8_0.json.gz", json.dumps({"meta": {"result_count": 0}, "includes": {"tweets": [post(9)]}}), True)
    put(tmp_path / "9_0.json.gz", "{not json", True)
    good = gzip.compress(json.dumps({"data": [post(i) for i in range(100, 3000)]}).encode())
    (tmp_path / "cut.json.gz").write_bytes(good[: len(good) // 2])
    read = pages.read_pages(spark, str(tmp_path))
    got = pages.page_posts(read)
    assert sorted((r.id, r.is_include) for r in got.collect()) == [("1", 0), ("2", 0), ("3", 1), ("4", 0)]
    assert [r[0] for r in pages.empty_conversations(read).collect()] == ["8"]
    where = {r.tweet_id: (r.filename.rsplit("/", 1)[1], r.includes) for r in pages.seed_locations(got).collect()}
    assert where["3"] == ("7_0.json.gz", 1)


def test_damaged_files_keep_what_comes_before(spark, tmp_path):
    documents = [json.dumps({"data": [post(100 * n + i) for i in range(40)]}) for n in range(60)]
    whole = gzip.compress("".join(d + "\n" for d in documents).encode())
    spoilt = bytearray(whole)
    spoilt[len(whole) // 2] ^= 0xFF
    files = {
        "whole.gz": whole + bytes(512),
        "cut.gz": whole[: 2 * len(whole) // 3],
        "spoilt.gz": bytes(spoilt),
        "tail.gz": whole + b"junk",
        "two.gz": whole + gzip.compress(documents[0].encode()),
        "plain.json": ("\n".join(documents[:2]) + "\n[1]\n{\n\n").encode(),
        "empty.json": b"",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    lines = packed.read_packed(spark, str(tmp_path))
    held = {}
    for r in lines.where("line is not null").collect():
        held.setdefault(r.file.rsplit("/", 1)[1], {})[r.line] = r.value
    values = {name: [own[i] for i in range(len(own))] for name, own in held.items()}
    assert values["whole.gz"] == values["tail.gz"] == documents and values["two.gz"] == [*documents, documents[0]]
    n = len(values["cut.gz"])
    assert values["cut.gz"] == documents[:n] and 5 < n < 60
    # Wrong bytes may be unpacked before the error is seen; what comes before them is whole.
    assert values["spoilt.gz"][:15] == documents[:15]
    report = {r.file.rsplit("/", 1)[1]: r for r in packed.unreadable_pages(lines).collect()}
    assert set(report) == {"cut.gz", "spoilt.gz", "tail.gz", "plain.json"}
    assert (report["cut.gz"].problem, report["cut.gz"].bytes_read) == ("cut off", 2 * len(whole) // 3)
    assert report["cut.gz"].pages_read == n and report["cut.gz"].bad_lines == 0
    assert (report["plain.json"].pages_read, report["plain.json"].bad_lines, report["plain.json"].problem) == (2, 2, None)
    assert (report["tail.gz"].pages_read, report["tail.gz"].bytes_read) == (60, len(whole))
    posts = pages.page_posts(packed.packed_pages(lines.where("file like '%whole.gz'")))
    assert posts.count() == 2400 and posts.first().filename.endswith("whole.gz")


def test_projection_of_a_post_without_references(spark, tmp_path):
    full = post(1, in_reply_to_user_id="w", referenced_tweets=[{"type": "replied_to", "id": "5"}], text="VOTE\t\n now")
    put(tmp_path / "a.json", json.dumps({"data": [full, post(2)]}))
    words = Dictionary.of(spark, {"midterms": ["vote"], "russia": ["zz"], "childcare": ["yy"]})
    read = pages.page_posts(pages.read_pages(spark, str(tmp_path)))
    rows = {r.pid: r for r in post_ops.project_page_posts(read, words).collect()}
    assert (rows["1"].parent_id, rows["1"].parent_author, rows["1"].text, rows["1"].topics) == ("5", "w", "VOTE now", ["midterms"])
    assert (rows["1"].midterms, rows["1"].russia, rows["2"].parent_id, rows["2"].quote_id) == (1, 0, None, None)


def comment(i, replies="", **more):
    return {"kind": "t1", "data": {"id": f"c{i}", "author": "a", "created_utc": 1.0, "parent_id": "t3_r", "body": f"b{i}", "replies": replies, **more}}


def nested(depth, at=0):
    below = {"data": {"children": [nested(depth, at + 1)]}} if at + 1 < depth else ""
    return comment(at, below)


def thread(children):
    root = {"data": {"id": "r", "author": "op", "created_utc": 0.0, "title": "T", "selftext": "S", "permalink": "/p/", "over_18": True}}
    return [{"data": {"children": [root]}}, {"data": {"children": children}}]


@pytest.mark.parametrize("depth", [1, 3, 10, 11, 35])
def test_threads_of_any_depth(spark, tmp_path, depth):
    put(tmp_path / "vote_r.json", json.dumps(thread([nested(depth), comment("x")]), indent=1))
    nodes = threads.thread_nodes(threads.read_threads(spark, str(tmp_path), whole_file=True))
    rows = {r.pid: r for r in threads.thread_posts(nodes).collect()}
    assert set(rows) == {"r", "cx"} | {f"c{i}" for i in range(depth)}
    assert (rows["r"].text, rows["r"].over18, rows["r"].parent_id) == ("T S", True, None)
    assert (rows["c0"].text, rows["c0"].parent_id, rows["c0"].conversation_id, rows["c0"].over18) == ("b0", "r", "r", False)


@pytest.mark.parametrize("depth", [198, 205, 250, 2000])
def test_threads_deeper_than_the_parser(spark, tmp_path, depth):
    stub = json.dumps({"kind": "more", "data": {"parent_id": f"t1_c{depth - 1}", "children": ["h1", "h2"]}})
    text = stub
    for i in reversed(range(depth)):
        above = comment(i, "@", parent_id=f"t1_c{i - 1}" if i else "t3_r", body=f'b{i} " \\ {{[\n')
        text = json.dumps(above).replace('"@"', f'{{"data": {{"children": [{text}]}}}}')
    flat = json.dumps(thread(["@", comment("x", extra={"replies": [1, {"a": None}]})]))
    put(tmp_path / "deep.json", flat.replace('"@"', text))
    put(tmp_path / "cut.json", flat.replace('"@"', text)[:-2])
    read = threads.read_threads(spark, str(tmp_path))
    assert [r.filename[-9:] for r in read.collect()] == ["deep.json"]
    nodes = threads.thread_nodes(read)
    rows = [tuple(r) for r in threads.thread_posts(nodes).select("pid", "conversation_id", "parent_id", "text").collect()]
    below = [(f"c{i}", "r", f"c{i - 1}" if i else "r", f'b{i} " \\ {{[') for i in range(depth)]
    assert sorted(rows, key=str) == sorted([("r", "r", None, "T S"), ("cx", "r", "r", "bx"), *below], key=str)
    stubs = {(r.pid, r.parent_id, r.conversation_id) for r in threads.thread_stubs(nodes).collect()}
    assert stubs == {("h1", f"c{depth - 1}", "r"), ("h2", f"c{depth - 1}", "r")}
    assert [r.filename[-8:] for r in threads.unreadable_threads(spark, str(tmp_path)).collect()] == ["cut.json"]


def test_both_ways_of_reading_threads_agree(spark, tmp_path, monkeypatch):
    odd = {"data": {"id": 7, "author": None, "created_utc": "x", "body": {"a": [1, "b"]}, "replies": [3]}}
    more = {"kind": "more", "data": {"parent_id": "t1_c0", "children": ["h1", "h2"]}}
    documents = [
        thread([nested(5), odd, {"kind": "t1"}, comment("y", json.dumps({"data": {"children": [comment("z")]}}))]),
        thread([comment(0, {"data": {"children": [comment(1), more]}}), comment("q", {"data": 3}), comment("p", {})]),
        [{"data": {"children": []}}, {"data": {"children": [comment("x")]}}, {"data": {"children": [comment("n")]}}],
        {"data": {"children": [comment("only")]}},
    ]
    put(tmp_path / "a.json", "\n".join(json.dumps(d) for d in documents) + "\n[{'data': {'children': [{'data': {'id': 'q'}}]}}]")
    first = threads.read_threads(spark, str(tmp_path))

    def fails(text):
        raise RecursionError

    monkeypatch.setattr(threads, "_DECODER", SimpleNamespace(raw_decode=fails, decode=fails))
    read = [(r.filename, *threads._flat(r.value)) for r in spark.read.text(str(tmp_path)).select(F.col("_metadata.file_path").alias("filename"), "value").collect()]
    second = spark.createDataFrame(read, first.schema)
    both = [sorted(map(str, threads.thread_nodes(way).collect())) for way in (first, second)]
    assert both[0] == both[1] and len(both[0]) == 19
    monkeypatch.undo()
    for text in ("", "[{", "[1,]", '{"a" 1}', '{"a":1,}', "[1 2]", "{]", "]", ",", "7", '["a\\x"]', '{"a":}'):
        assert threads._flat(text) is None


def test_threads_are_read_in_one_pass(spark, tmp_path, monkeypatch):
    """Nothing is written on the way, however deep; numbers stay as they were written."""
    text = json.dumps(thread([nested(150), comment("n", body=12345678901234567890123)]))
    put(tmp_path / "deep.json", text)
    monkeypatch.setattr("threadloom.session.materialise", lambda *a: pytest.fail("written"))
    nodes = threads.thread_nodes(threads.read_threads(spark, str(tmp_path)))
    posts = {r.pid: r.text for r in threads.thread_posts(nodes).collect()}
    assert len(posts) == 152 and posts["cn"] == "12345678901234567890123"


def test_collapsed_nodes_at_both_levels(spark, tmp_path):
    more = {"kind": "more", "data": {"parent_id": "t1_c0", "children": ["h1", "h2"]}}
    top = {"kind": "more", "data": {"parent_id": "t3_r", "children": ["h3"]}}
    document = thread([comment(0, {"data": {"children": [comment(1), more]}}), top])
    put(tmp_path / "one.json", json.dumps(document))
    nodes = threads.thread_nodes(threads.read_threads(spark, str(tmp_path)))
    stubs = {r.pid: r.parent_id for r in threads.thread_stubs(nodes).collect()}
    assert stubs == {"h1": "c0", "h2": "c0", "h3": "r"}
    words = Dictionary.of(spark, {t: [f"#{t}"] for t in schemas.TOPICS})
    table = post_ops.project_thread_posts(threads.thread_posts(nodes), threads.thread_stubs(nodes), words)
    rows = {r.pid: r for r in table.collect()}
    assert rows["h1"].is_stub and rows["h1"].author is None and rows["h1"].russia is None and rows["h1"].over18 is None
    assert rows["c1"].conversation_id == "r" and rows["c1"].russia == 0 and len(rows) == 6


def test_unreadable_threads_are_reported(spark, tmp_path):
    put(tmp_path / "a.json", json.dumps(thread([])))
    put(tmp_path / "b.json", "[{")
    put(tmp_path / "c.json", "{}")
    put(tmp_path / "d.json", "\n")
    assert threads.read_threads(spark, str(tmp_path)).count() == 1
    left_out = {r.filename[-6:]: (r.length, r.reason) for r in threads.unreadable_threads(spark, str(tmp_path)).collect()}
    assert left_out == {"b.json": (2, "no JSON array of listings"), "c.json": (2, "no posts")}


def test_tsv_keeps_long_ids_and_stray_quotes(spark, tmp_path):
    big = "1597610374539423747"
    put(tmp_path / "7.txt", f'pid\tconversation_id\tparent_id\ttox\n{big}\t7\tnan\t0.5\n2\t7\t{big}\t\n"3\t7\t"x\tnan\n')
    schema = schemas.T.StructType([f for f in schemas.POSTS_TSV if f.name in ("pid", "conversation_id", "parent_id", "tox")])
    rows = [tuple(r) for r in tables.read_tsv(spark, str(tmp_path), schema).orderBy("pid").collect()]
    assert rows == [('"3', "7", '"x', None), (big, "7", None, 0.5), ("2", "7", big, None)]


def test_lists_dictionaries_and_dumps(spark, tmp_path):
    put(tmp_path / "ids.txt", "a\n\n b \na\tx\n")
    assert sorted(r.id for r in tables.read_id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]
    put(tmp_path / "k.json", json.dumps({"t": ["x", "y"], "u": ["z"]}))
    assert sorted(tuple(r) for r in tables.read_keywords(spark, str(tmp_path / "k.json")).collect()) == [("t", "x"), ("t", "y"), ("u", "z")]
    (tmp_path / "dump").mkdir()
    put(tmp_path / "dump" / "vote.txt", json.dumps({"id": "1", "utc_datetime_str": "s"}) + "\n" + json.dumps({"id": "2"}))
    got = tables.read_comment_dump(spark, str(tmp_path / "dump")).collect()
    assert sorted((r.id, r.keyword, r.utc_datetime_str) for r in got) == [("1", "vote", "s"), ("2", "vote", None)]


def test_survey_drops_sub_headers_and_personal_data(spark, tmp_path):
    sheet = (
        "StartDate,IPAddress,ResponseId,RecipientLastName,77,77_topic,77_english,88,88_topic\n"
        "Start,IP,Response ID,Name,Q1,Q2,Q3,Q4,Q5\n"
        '"{""ImportId"":""s""}",x,"{""ImportId"":""r""}",x,x,x,x,x,x\n'
        'd,"1,2",R_1,Ann,Yes,"Russia, war",Yes,No,\n'
        "d,1,R_2,Bob,No,,,Not sure,Other\n"
    )
    put(tmp_path / "round1.csv", sheet)
    got = {(r.coder, r.cid, r.field): r.code for r in survey.read_survey(spark, str(tmp_path)).collect()}
    assert got["Ann", "77", "topic"] == "Russia, war" and got["Ann", "88", "topic"] is None
    assert got["Bob", "88", "on_topic"] == "Not sure" and got["Ann", "77", "english"] == "Yes"
    assert len(got) == 10 and {k[1] for k in got} == {"77", "88"}


def test_overwriting_one_platform_leaves_the_other(spark, tmp_path):
    path = str(tmp_path / "posts")
    rows = spark.createDataFrame([("a", "1", "c"), ("b", "2", "c")], "platform string, pid string, conversation_id string")
    posts = post_ops.conform(rows)
    sinks.write_posts(posts, path)
    sinks.write_posts(posts.where("platform = 'b'").withColumn("pid", F.lit("3")), path, "overwrite")
    got = spark.read.schema(schemas.POSTS).parquet(path)
    assert sorted(r.pid for r in got.collect()) == ["1", "3"]


def test_files_hold_sorted_ranges_of_conversations(spark, tmp_path):
    path = str(tmp_path / "posts")
    rows = spark.range(3000).selectExpr(
        "'a' as platform", "cast(id as string) as pid", "concat('c', id * 7919 % 500) as conversation_id"
    )
    sinks.write_posts(post_ops.conform(rows.repartition(8)), path)
    spans = []
    for file in sorted((tmp_path / "posts" / "platform=a").glob("*.parquet")):
        ids = [r[0] for r in spark.read.parquet(str(file)).select("conversation_id").collect()]
        assert ids == sorted(ids)
        spans.append((ids[0], ids[-1]))
    spans.sort()
    assert all(before[1] <= after[0] for before, after in zip(spans, spans[1:]))


def test_blanks_in_text_do_not_break_cells(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("1", "c", "two\tcells\nand \r\n lines"), ("2", "c\td", None)]
    sinks.write_tsv(spark.createDataFrame(rows, "pid string, conversation_id string, text string"), path)
    schema = schemas.T.StructType([f for f in schemas.POSTS_TSV if f.name in ("pid", "conversation_id", "text")])
    got = sorted(tuple(r) for r in tables.read_tsv(spark, path, schema).collect())
    assert got == [("1", "c", "two cells and lines"), ("2", "c d", None)]
