import json
import os

import pytest
from pyspark.sql import functions as F

from lettermill.archive import MailArchive, merge_mailboxes
from lettermill.config import Config, load_config, save_config
from lettermill.functions import text as T
from lettermill.operators import export, ordering, threads
from lettermill.plans.search import search
from lettermill.schema import ExportError, MailboxNotFound
from lettermill.sources.eml import read_eml
from lettermill.sources.index import build_index, freshness, load_index
from lettermill.sources.mbox import fetch_raw, read_mbox
from lettermill.sources.naming import display_name, unique_display_names
from lettermill.streaming.tail import tail_mbox


def mail(i, subject, body="text", extra="", sender="user"):
    return f"From {sender}{i}@x Thu Jan  {i} 00:00:00 2015\nFrom: {sender.title()} {i} <{sender}{i}@x>\nTo: team@x\nSubject: {subject}\nMessage-ID: <m{i}@x>\nDate: Thu, 0{i} Jan 2015 10:00:00 +0000\n{extra}\n{body}\n\n"


PARTS = 'Content-Type: multipart/mixed; boundary="b"\n'
BODY = '--b\nContent-Type: text/plain\n\nsee file\n--b\nContent-Type: text/plain\nContent-Disposition: attachment; filename="notes.txt"\n\nhej\n--b--'


@pytest.fixture(scope="module")
def mbox(tmp_path_factory):
    path = tmp_path_factory.mktemp("box") / "simple.mbox"
    mails = [mail(1, "Hello World"), mail(2, "Re: Hello World", "a perspective", "References: <m1@x>\nX-Gmail-Labels: Inbox,Work\n"), mail(3, "Meeting tomorrow", ">From me"), mail(4, "Files", BODY, PARTS), mail(5, "=?utf-8?q?=C3=9Cber?=", "last", "X-Gmail-Labels: Work\n")]
    path.write_bytes("".join(mails).encode())
    return str(path)


def test_scan_is_the_same_for_any_split(spark, mbox):
    whole = [tuple(r) for r in read_mbox(spark, mbox).select("offset", "length", "sequence", "subject").orderBy("offset").collect()]
    assert len(whole) == 5 and whole[-1][3] == "Über" and sum(r[1] for r in whole) == os.path.getsize(mbox)
    for step in (64, 300):
        assert [tuple(r) for r in read_mbox(spark, mbox, range_bytes=step).select("offset", "length", "sequence", "subject").orderBy("offset").collect()] == whole


def test_missing_and_empty(spark, tmp_path):
    with pytest.raises(MailboxNotFound):
        read_mbox(spark, str(tmp_path / "none.mbox"))
    (tmp_path / "empty.mbox").write_bytes(b"")
    assert read_mbox(spark, str(tmp_path / "empty.mbox")).count() == 0


@pytest.mark.parametrize(
    ("query", "found"),
    [("", 5), ("perspective", 1), ("-perspective", 4), ("perspective OR Meeting", 2), ("from:user3", 1), ("label:work", 2), ("has:attachment", 1), ("filename:notes", 1), ('filename:"notes"', 0), ('filename:"NOTES.txt"', 1), ("date:2015-01-02", 1), ("after:2015-01-04", 2), ('body:perspective OR subject:"Meeting tomorrow" from:user3', 1), ("size:>100000", 0)],
)
def test_search(spark, mbox, query, found):
    assert search(read_mbox(spark, mbox).drop("raw"), query).count() == found


def test_unreadable_bodies_match_nothing(spark, mbox):
    m = read_mbox(spark, mbox)
    blind = lambda df: df.withColumn("body", F.lit(None).cast("struct<text:string,html:string,raw_headers:string,attachments:array<struct<filename:string>>>"))
    assert search(m, "-body:x", with_body=blind).count() == 0


def test_filters_come_before_decoding(spark, mbox):
    plan = search(read_mbox(spark, mbox).drop("raw"), "from:user3 body:x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.rindex("user3")


def test_index(spark, mbox, tmp_path):
    where = str(tmp_path / "idx")
    assert load_index(spark, mbox, where) is None
    assert build_index(spark, mbox, where=where).count() == 5
    assert load_index(spark, mbox, where).count() == 5
    manifest = os.path.join(where, "manifest.json")
    kept = json.load(open(manifest))
    for change in ({"size": 1}, {"version": 0}, {"row_count": 4}, {"prefix_sha256": ""}):
        json.dump(kept | change, open(manifest, "w"))
        assert load_index(spark, mbox, where) is None
    assert build_index(spark, mbox, where=where).count() == 5 and freshness(mbox)["size"] == os.path.getsize(mbox)


def test_threads(spark, mbox):
    m = read_mbox(spark, mbox)
    rows = {r.sequence: r for r in threads.thread_nodes(m).collect()}
    assert rows[0].thread_key == rows[1].thread_key and (rows[0].depth, rows[1].depth) == (0, 1)
    assert threads.thread_summary(m).count() == 4
    first = threads.thread_order(threads.thread_nodes(m)).first()
    assert first.sequence == 4


def test_thread_rules(spark):
    schema = "sequence long, date timestamp, message_id string, `references` array<string>, in_reply_to string, subject string, thread_id string"
    from datetime import datetime

    rows = [
        (0, "<a>", ["<b>"], None, "A", None), (1, "<b>", ["<a>"], None, "B", None),  # a circle: the second link is refused
        (2, "<a>", [], "<b>", "A", None),  # an id that is taken already is still linked
        (3, "", ["<a>"], None, "re: X", None), (4, "", [], None, "X", None),  # no ids: by subject
        (5, "<p>", ["<gone>"], None, "P", "7"), (6, "<q>", ["<gone>"], None, "Q", None), (7, "<z>", [], None, "Z", "7"),
    ]
    df = spark.createDataFrame([(s, datetime(2024, 1, 1, s), m, r, i, sub, t) for s, m, r, i, sub, t in rows], schema)
    got = {r.sequence: (r.thread_key, r.depth) for r in threads.thread_nodes(df).collect()}
    assert got == {0: ("b", 1), 1: ("b", 0), 2: ("b", 1), 3: ("x", 0), 4: ("x", 0), 5: ("7", 0), 6: ("7", 0), 7: ("7", 0)}


def test_exports(spark, mbox, tmp_path):
    a = MailArchive(spark, mbox, index=False)
    assert a.export("eml", str(tmp_path / "eml"), "from:user") == 5
    assert read_eml(spark, str(tmp_path / "eml")).count() == 5
    assert b"\nFrom me" in (tmp_path / "eml" / "20150103_100000_user3_x_Meeting_tomorrow.eml".replace("user3_x", "user3@x")).read_bytes()
    assert a.export("csv", str(tmp_path / "out")) == 5
    csv = (tmp_path / "out" / "export.csv").read_bytes()
    assert csv.startswith(b"\xef\xbb\xbfDate,From") and csv.count(b"\n") == 6
    assert a.export("text", str(tmp_path / "txt"), "subject:files") == 1
    assert "notes.txt" in next((tmp_path / "txt").iterdir()).read_text()
    assert a.export("html", str(tmp_path / "html"), "subject:hello") == 2
    assert a.export("mbox", str(tmp_path / "again.mbox")) == 5
    assert [r[0] for r in read_mbox(spark, str(tmp_path / "again.mbox")).orderBy("sequence").select("message_id").collect()] == [f"<m{i}@x>" for i in range(1, 6)]
    assert a.export_attachments(str(tmp_path / "att")) == 1
    assert (tmp_path / "att" / "20150104_100000_Files" / "notes.txt").read_bytes().strip() == b"hej"
    with pytest.raises(ExportError):
        a.export("pdf", str(tmp_path))
    raw = fetch_raw(a.messages.where("sequence = 3")).first()["raw"]
    assert export.extract_attachment(bytes(raw), 0).strip() == b"hej" and export.extract_attachment(bytes(raw), 5) is None


def test_merge(spark, mbox, tmp_path):
    other = tmp_path / "other.mbox"
    other.write_bytes((mail(2, "again") + mail(6, "new")).encode())
    out = str(tmp_path / "merged.mbox")
    s = merge_mailboxes(spark, [mbox, str(other)], out, dedup=True, add_source=True)
    assert (s["total_messages"], s["duplicates_removed"], s["input_files"], s["source_headers"]) == (6, 1, 2, 6)
    assert open(out, "rb").read().count(b"X-Mbox-Source: other.mbox") == 1
    assert merge_mailboxes(spark, [mbox, str(other)], out, dedup=False)["total_messages"] == 7
    assert open(out, "rb").read() == open(mbox, "rb").read() + other.read_bytes()


def test_names(spark):
    rows = spark.createDataFrame([(1, "a.txt"), (2, "a.txt"), (3, "a.txt"), (4, ".hidden"), (5, ".hidden")], "sequence long, name string")
    assert [r.name for r in export.unique_names(rows).orderBy("sequence").collect()] == ["a.txt", "a_1.txt", "a_2.txt", ".hidden", ".hidden_1"]
    assert display_name("/x/Name.mbox/mbox") == "Name.mbox" and display_name("/g@googlegroups.com/topics.mbox") == "g@googlegroups.com"
    assert unique_display_names(["/a/x.mbox", "/b/x.mbox", "/c/y.mbox"]) == ["a/x.mbox", "b/x.mbox", "y.mbox"]
    assert unique_display_names(["/a/x", "/a/x"]) == ["x", "x"] or len(set(unique_display_names(["/a/x", "/a/x"]))) == 1


def test_text_functions(spark):
    row = spark.createDataFrame([("=1+1", "ab/../c é.", "x" * 300)], "a string, b string, c string").select(T.csv_field(F.col("a")).alias("a"), T.file_name_part(F.col("b"), 20).alias("b"), F.length(T.cut_bytes(F.concat(F.lit("é"), F.col("c")), 10)).alias("c"), T.human_size(F.lit(1536)).alias("d"), T.thread_indent(F.lit(2)).alias("e")).first()
    assert (row.a, row.b, row.c, row.d, row.e) == ("'=1+1", "ab___c_é", 9, "1.50 KiB", "│└ ")
    assert T.match_ranges("Éa éA", "éa") == [(0, 3), (4, 7)] and T.match_ranges("aaa", "aa") == [(0, 2)] and T.match_ranges("x", "") == []
    assert T.terminal_line("a\tb\x07") == "a       b�" and T.cut_width("日本語テキスト", 9) == "日本語..." and T.cut_width("abc", 3) == "abc"
    assert T.wrap_next(4, 5) == 0 and T.wrap_next(0, 5, -1) == 4 and T.wrap_next(0, 0) is None


def test_order(spark, mbox):
    m = read_mbox(spark, mbox)
    assert [r.sequence for r in ordering.page(m, 1, 2).collect()] == [3, 2]
    assert [r["rank"] for r in ordering.ranked(m.select("sequence", "date"), ordering.sort_keys()).orderBy("sequence").collect()] == [5, 4, 3, 2, 1]
    s = ordering.SortState().choose("date").choose("from")
    assert (s.by, s.descending) == ("from", False)
    h = ordering.SearchHistory(2)
    for q in "abac":
        h.push(q)
    assert h.items == ["c", "a"]


def test_stats(spark, mbox):
    a = MailArchive(spark, mbox, index=False)
    doc = json.loads(a.stats_json())
    assert doc["message_count"] == 5 and doc["with_attachments"] == 1 and len(doc["top_senders"]) == 5 and doc["date_range"]["oldest"].startswith("2015-01-01")
    assert [tuple(r) for r in a.labels().collect()] == [("Inbox", 1), ("Work", 2)]
    empty = a.messages.where("false")
    from lettermill.operators.stats import summary

    assert tuple(summary(empty).first())[:4] == (0, None, None, 0)


def test_stream(spark, mbox, tmp_path):
    growing = tmp_path / "grow.mbox"
    data = open(mbox, "rb").read()
    growing.write_bytes(data)
    q = tail_mbox(spark, str(growing)).select("offset", "subject").writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    assert spark.table("tail").count() == 4  # the last one may still grow
    with growing.open("ab") as f:
        f.write(mail(6, "sixth").encode() + mail(7, "seventh").encode())
    q.processAllAvailable()
    q.stop()
    assert spark.table("tail").count() == 6 and spark.table("tail").select("offset").distinct().count() == 6


def test_config(tmp_path):
    path = str(tmp_path / "c.toml")
    save_config(Config(top_senders=3, cache_dir='a"b'), path)
    assert load_config(path) == Config(top_senders=3, cache_dir='a"b')
    open(path, "w").write("top_senders = [")
    assert load_config(path) == Config() == load_config(str(tmp_path / "none"))


def test_commands(spark, mbox, tmp_path, capsys):
    from lettermill.__main__ import parser, run

    say = lambda *argv: (run(spark, parser().parse_args(list(argv))), capsys.readouterr().out)[1]
    assert json.loads(say("index", mbox))["messages"] == 5
    assert json.loads(say("stats", mbox, "--json"))["message_count"] == 5 and "5 messages" in say("stats", mbox)
    assert json.loads(say("search", mbox, "perspective", "--json"))["result_count"] == 1
    assert "Hello World" in say("search", mbox, "from:user1") and "hello world" in say("threads", mbox)
    assert say("export", mbox, "-F", "mbox", "-o", str(tmp_path / "o.mbox"), "-q", "label:work").startswith("2 ")
    assert say("attachments", mbox, "-o", str(tmp_path / "a")).startswith("1 ")
    assert json.loads(say("merge", mbox, mbox, "-o", str(tmp_path / "m.mbox"), "--dedup"))["duplicates_removed"] == 5
