from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orelake.functions import normalize as N
from orelake.operators import merge, quality, retrieve, scd2, text
from orelake.plans import dag
from orelake.sources import files, generate, jdbc
from orelake.store import Contract, ContractError, Table
from orelake.streaming import ingest

END = datetime(2026, 1, 1)
RULES = quality.silver_rules("timestamp'2026-01-01 00:00:00'")


def test_timestamps(spark):
    rows = [("2026-01-02 03:04:05",), (" 2026-01-02T03:04:05 ",), ("2026-01-02T03:04:05.000006",), ("02.01.2026 03:04:05",), ("31/02/2026 25:61",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(N.order_ts(F.col("s"))).collect()]
    want = datetime(2026, 1, 2, 3, 4, 5)
    assert got == [want, want, want.replace(microsecond=6), want, None, None]


def test_boundaries(spark):
    hours = spark.createDataFrame([(h,) for h in (0, 5, 6, 11, 12, 17, 18, 23, None)], "h int").select(N.day_part(F.col("h"))).collect()
    assert [r[0] for r in hours] == ["night", "night", "morning", "morning", "afternoon", "afternoon", "evening", "evening", "evening"]
    buckets = spark.createDataFrame([("49.99",), ("50",), ("149.99",), ("150",)], "a string").select(N.amount_bucket(N.money(F.col("a")))).collect()
    assert [r[0][0] for r in buckets] == ["1", "2", "3", "4"]


@pytest.mark.parametrize("n,k", [(200, 3)])
def test_split(spark, n, k):
    bronze = N.parse_orders(spark.createDataFrame(generate.orders(n, k, end=END), generate.RAW))
    flagged = quality.flag(bronze, RULES)
    good, bad = quality.silver(flagged), quality.quarantine(flagged)
    assert (good.count(), bad.count()) == (n, 10 * k)
    reasons = {r.rule: r.rows for r in quality.quarantine_reasons(bad).collect()}
    assert reasons == {"amount_in_range": 9, "customer_format": 6, "order_ts_not_in_future": 6, "customer_not_null": 3, "order_id_not_null": 3, "channel_accepted": 3, "order_ts_parsed": 3, "unique_order_id": 3}


def test_duplicate_keeps_first_clean(spark):
    rows = [("1", "cust_1", "web", "5", f"2025-01-01 {h}:00:00") for h in (11, 12)] + [("1", "cust_1", "fax", "5", "2025-01-01 09:00:00")]
    good = quality.silver(quality.flag(N.parse_orders(spark.createDataFrame(rows, generate.RAW)), RULES)).collect()
    assert [r.order_ts.hour for r in good] == [11]


def test_statuses(spark):
    d = spark.createDataFrame([(1, "a", "web"), (1, None, "fax"), (2, "b", None)], "id int, name string, channel string")
    r = {x.check_name: (x.failed_rows, x.status) for x in quality.results(d, "l", "t", [*quality.not_null("name", threshold=0.5), quality.unique("id"), quality.accepted("channel", ["web"], blocking=False)]).collect()}
    assert r == {"name_not_null": (1, "PASS"), "id_unique": (1, "FAIL"), "channel_accepted_values": (2, "WARN")}
    empty = d.where("false")
    assert quality.results(empty, "l", "t", [*quality.not_null("id")]).first().status == "PASS"
    assert quality.freshness(empty.withColumn("ts", F.current_timestamp()), "l", "t", "ts", timedelta(days=1), END).first().status == "WARN"


def test_expect_fail(spark):
    d = spark.createDataFrame([(1,), (None,)], "x int")
    with pytest.raises(Exception, match="expectation present failed"):
        quality.expect(d, [quality.Rule("present", "x IS NOT NULL")], "fail").count()


def test_declared_items_count_once(spark):
    checks = [{"name": "k", "check": {"function": "is_not_null", "for_each_column": ["a", "b"]}}, {"name": "u", "criticality": "warn", "check": {"function": "is_unique", "arguments": {"columns": ["a"]}}}]
    f = quality.apply_checks(spark.createDataFrame([(None, None), (1, 1), (1, 2)], "a int, b int"), checks)
    assert {x.check_name: (x.failed_rows, x.status) for x in quality.declared_results(f, checks, "l", "t").collect()} == {"dqx_k": (1, "FAIL"), "dqx_u": (2, "WARN")}
    assert quality.issues(f).count() == 3


def test_store(spark, tmp_path):
    d = spark.createDataFrame([(1, "web"), (2, "store")], "id int, channel string")
    c = Contract(d.schema, ("id",), {"channel": "channel IN ('web', 'store')"}, ("id",))
    t = Table(spark, f"file://{tmp_path}/t", c)
    assert t.load_once(d, 2) and not t.load_once(d)
    for bad in ([(None, "web")], [(3, "fax")], [(3, "web"), (3, "web")]):
        with pytest.raises(ContractError):
            t.write(spark.createDataFrame(bad, d.schema))
    with pytest.raises(ContractError):
        t.write(d.withColumn("extra", F.lit(1)))
    t.write(t.read().withColumn("id", F.col("id") + 1))  # from itself
    assert [r._change_type for r in t.changes(1, 2, ["id"]).orderBy("id").collect()] == ["delete", "update_preimage", "update_postimage", "insert"]
    assert t.vacuum() == 1 and t.read().count() == 2
    free = Table(spark, f"file://{tmp_path}/f")
    free.append(d)
    with pytest.raises(ContractError):
        free.append(d.withColumn("region", F.lit("x")))
    free.append(d.withColumn("region", F.lit("x")), merge_schema=True)
    assert free.read().where("region IS NULL").count() == 2


def test_insert_only_stream_replay(spark, tmp_path):
    src = f"{tmp_path}/in"
    generate.events(spark, "p", 0, 100).write.parquet(f"{src}")
    schema = spark.read.parquet(src).schema
    t = Table(spark, f"file://{tmp_path}/silver")
    go = lambda: ingest.insert_only(spark.readStream.schema(schema).parquet(src), t, ["event_id"], f"{tmp_path}/cp")
    go()
    generate.events(spark, "p", 90, 110).write.mode("append").parquet(src)
    go()
    go()
    bronze = spark.read.parquet(src)
    assert (bronze.count(), t.read().count()) == (120, 110)
    assert all(quality.replay_checks(bronze, t.read(), "event_id", 120).first())


def test_rescue(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "extra": "x"}\n{"id": "2"}\nbroken\n')
    rows = {r.id: r._rescued_data for r in files.json_lines(spark, str(tmp_path), "id string").collect()}
    assert rows == {"1": '{"extra":"x"}', "2": None, None: "broken"}
    assert files.widened("id string", spark.read.text(str(tmp_path))) == "id string, `extra` string"


def test_sequenced_order_of_arrival(spark):
    rows = [(1, "a", 1), (1, "a", 2), (1, "b", 3), (1, None, 4), (2, "x", 1)]
    one = scd2.sequenced(spark.createDataFrame(rows, "k int, v string, s int"), ["k"], ["v"], F.col("s"))
    other = scd2.sequenced(spark.createDataFrame(rows[::-1], "k int, v string, s int"), ["k"], ["v"], F.col("s"))
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect())) and one.count() == 4


def test_upsert_guard(spark):
    t, s = (spark.createDataFrame(x, "k int, v int") for x in ([(1, 5)], [(1, 3), (2, 1)]))
    assert sorted(map(tuple, merge.upsert(t, s, ["k"], "v").collect())) == [(1, 5), (2, 1)]


GUIDE = """---
title: "Bins: a guide"
---
import { Tabs } from "x";
<!-- a note
over lines -->
<Aside
  type="CAUTION"
>
Several lines. See [the list](/list/). ![pic](a.png)
</Aside>
# Turn `on`
<Tabs>
    ```sql
    # no heading

    SELECT 1;
    ```
</Tabs>
## Limits ##
Few.

#### Deep
End.
# Next
~~~
open"""


def test_pages_are_scanned():
    meta, body = text.front_matter(GUIDE.replace("\n", "\r\n"))
    page = text.scan(body)
    assert meta == {"title": "Bins: a guide"}
    parts = {n: page.text[a:b].strip() for n, a, b in text.sections(page)}
    assert parts == {
        "": "Caution:\nSeveral lines. See the list.",
        "Turn `on": "```sql\n# no heading\n\nSELECT 1;\n```",
        "Turn `on > Limits": "Few.",
        "Turn `on > Limits > Deep": "End.",
        "Next": "~~~\nopen",
    }
    assert [page.text[a:b] for a, b in page.code] == ["```sql\n# no heading\n\nSELECT 1;\n```", "~~~\nopen"]
    assert text.front_matter("---\nno end") == ({}, "---\nno end") and text.clean('<Aside title="hELLO">\nx\n') == "Hello:\nx"
    assert text.clean("") == "" and text.chunk_page("p", None, "small") == []


def test_chunks_are_bounded_and_lose_nothing():
    import random

    r = random.Random(1)
    for profile, (most, overlap) in text.PROFILES.items():
        for _ in range(40):
            words = [f"w{k}" + "x" * r.randrange(1, 9) for k in range(r.randrange(20, 1500))]
            body, at = "", 0
            while at < len(words):
                n = r.randrange(1, 60)
                body += " ".join(words[at : at + n]) + r.choice(("\n\n", "\n", " "))
                at += n
            rows = text.chunk_page("p", body, profile)
            assert [x[5] for x in rows] == list(range(len(rows))) and all(len(x[6]) <= most and x[6].startswith("p\n\n") for x in rows)
            held = [x[6].removeprefix("p\n\n") for x in rows]
            assert " ".join(held).split() and set(words) == {w for c in held for w in c.split()}
            for a, b in zip(held, held[1:]):  # what a chunk begins with is the end of the one before, or new text
                again = max(k for k in range(overlap + 1) if a.endswith(b[:k]))
                assert b[again:].split()[0] == words[words.index(a.split()[-1]) + 1]
    assert "".join(text.pieces("a" * 2000, 800)) == "a" * 2000
    assert sum(len(c.replace(" ", "").replace("\n", "")) for c in text.packed(text.pieces("x " * 2000, 300), 300, 0)) == 2000
    rows = text.chunk_page("long", "---\ntitle: " + "T" * 900 + "\n---\n" + "word " * 300, "small")
    assert rows and all(x[6].startswith("T" * 900) for x in rows)


def test_retrieval_helpers(spark):
    d = spark.createDataFrame([(" I don't know based on the docs", ["a", "b"], "b"), ("See [2] and [1][9]", ["a", "b"], "c")], "answer string, docs array<string>, expected string")
    r = d.select(retrieve.is_abstention(F.col("answer")), retrieve.cited(F.col("answer"), F.col("docs")), retrieve.hit_rank(F.col("expected"), F.col("docs"))).collect()
    assert [tuple(x) for x in r] == [(True, [], 2), (False, ["a", "b"], None)]
    said = ['x {"correct": "yes", "relevant": 1, "grounded": [1]}', "no object", None, '{"correct": true, "relevant": 0} {"relevant": 1}']
    j = spark.createDataFrame([(t,) for t in said], "t string").select(retrieve.judgement(F.col("t")).alias("j")).select("j.*").collect()
    assert [tuple(x) for x in j] == [(1, 1, 0), (0, 0, 0), (0, 0, 0), (1, 0, 0)]
    m = d.select(retrieve.messages(F.col("answer"), F.col("expected")).alias("m"), retrieve.judge_messages(F.col("answer"), F.col("expected"), F.col("expected")).alias("j")).first()
    assert [x.role for x in m.m] == ["system", "user"] and m.m[1].content.startswith("Passages:\n\nb") and "correct, relevant, grounded" in m.j[0].content


def test_runner():
    out, report = dag.run([dag.Step("b", lambda o: o["a"] + 1, ("a",)), dag.Step("a", lambda o: 1), dag.Step("c", lambda o: 1 / 0, ("b",)), dag.Step("d", lambda o: 2, ("c",)), dag.Step("clean", lambda o: 3, always=True)])
    assert out == {"a": 1, "b": 2, "clean": 3} and [s for _, s, _, _ in report.rows] == ["SUCCESS", "SUCCESS", "FAILED", "SKIPPED", "SUCCESS"] and report.exit_code == 1


def test_federation(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    d = spark.createDataFrame([(1, "F", 2.0), (2, "O", 3.0)], "ID int, ST string, AMT double")
    jdbc.write(d, url, "ORD", "ST VARCHAR(10)", driver=driver)
    jdbc.register(spark, "fed", url, driver)
    q = spark.sql("SELECT count(*) AS n, sum(AMT) AS s FROM fed.APP.ORD WHERE ST = 'F'")
    assert tuple(q.first()) == (1, 2.0)
    assert "PushedAggregates: [COUNT(*)" in q._jdf.queryExecution().toString()
    spark.createDataFrame([("F", True), ("O", False)], "code string, done boolean").createOrReplaceTempView("local_status")
    j = spark.sql("SELECT done, sum(AMT) AS s FROM fed.APP.ORD JOIN local_status ON ST = code GROUP BY done")
    assert {tuple(r) for r in j.collect()} == {(True, 2.0), (False, 3.0)}


def test_entry_survives_without_corpus_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)


def test_append_adds_a_folder_and_keeps_the_key(spark, tmp_path):
    d = spark.createDataFrame([(1, "web")], "id int, channel string")
    t = Table(spark, f"file://{tmp_path}/t", Contract(d.schema, ("id",), {}, ("id",)))
    for i in range(3):
        t.append(spark.createDataFrame([(i, "web")], d.schema))
    folders = [f for _, f in t.history()]
    assert [len(f) for f in folders] == [1, 2, 3] and folders[2][:2] == folders[1]
    with pytest.raises(ContractError, match="primary_key"):
        t.append(d)
    assert t.read().count() == 3 and t.read(1).count() == 1 and t.vacuum() == 2 and t.read().count() == 3
    t.write(t.read().where("id > 0"))
    assert t.vacuum() == 1 and sorted(r.id for r in t.read().collect()) == [1, 2]


def test_csv_stream_evolves(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.csv").write_text("order_id,customer,amount\n1,ann,2.5\n2,bob,x\n")
    read = lambda schema: files.csv_lines(spark, str(src), schema, stream=True)
    q = ingest.append_all(read("order_id int, customer string, amount double"), out, str(tmp_path / "cp"))
    assert ingest.progress(q)["rows"] == 3  # lines, the header with them
    (src / "b.csv").write_text("order_id,customer,amount,region\n3,cid,4.0,north\n")
    ingest.append_all(read("order_id int, customer string, amount double"), out, str(tmp_path / "cp"))
    rows = {r.order_id: r for r in spark.read.parquet(out).collect()}
    assert rows[1]._rescued_data is None and rows[2]._rescued_data == "2,bob,x" and rows[2].amount is None and rows[3]._rescued_data == "north"
    # A restart declares the wider schema and goes on from the checkpoint.
    (src / "c.csv").write_text("order_id,customer,amount,region\n4,dan,1.0,south\n")
    ingest.append_all(read("order_id int, customer string, amount double, region string"), out, str(tmp_path / "cp"))
    rows = {r.order_id: r for r in spark.read.option("mergeSchema", "true").parquet(out).collect()}
    assert rows[4].region == "south" and rows[3].region is None and len(rows) == 4


def test_tables_by_sql(spark, tmp_path):
    from orelake.operators import secure

    spark.sql("CREATE SCHEMA IF NOT EXISTS lake")
    spark.sql("CREATE TABLE lake.snap USING parquet AS SELECT id, current_timestamp() AS _ingested_at FROM VALUES (1), (2) AS t(id)")
    spark.sql("INSERT INTO lake.snap VALUES (3, current_timestamp())")
    assert spark.table("lake.snap").count() == 3 and "snap" in [r.tableName for r in spark.sql("SHOW TABLES IN lake").collect()]
    user = spark.sql("SELECT current_user()").first()[0]
    spark.createDataFrame([(user, "a", False)], "user_email string, segment string, full_access boolean").createOrReplaceTempView("access_of")
    spark.createDataFrame([("a", "x"), ("b", "y")], "segment string, name string").createOrReplaceTempView("people")
    secure.create_secure_view(spark, "seen", "people", "access_of", "segment", "name")
    assert [tuple(r) for r in spark.table("seen").collect()] == [("a", "***")]
    spark.sql("DROP SCHEMA lake CASCADE")


def test_store_then_gate(spark, tmp_path):
    from orelake import more

    bronze = N.parse_orders(spark.createDataFrame(generate.orders(50, 1, end=END), generate.RAW))
    checks = [c if c["check"]["function"] != "is_not_in_future" else {**c, "check": {**c["check"], "arguments": {**c["check"]["arguments"], "now": "timestamp'2026-01-01 00:00:00'"}}} for c in more.SILVER_CHECKS]
    path = tmp_path / "checks.json"
    path.write_text(__import__("json").dumps(checks))
    loaded = quality.load_checks(str(path))
    flagged = quality.apply_checks(bronze, loaded)
    table = Table(spark, f"file://{tmp_path}/issues")
    table.append(quality.issues(flagged))
    results = quality.declared_results(flagged, loaded, "silver", "orders")
    with pytest.raises(quality.DataQualityError, match="dqx_silver_amount_in_range"):
        quality.gate(results)
    assert table.read().count() == 11  # each fault, and the row that the duplicate repeats
    with pytest.raises(ValueError):
        quality.validate_checks([{"name": "x", "check": {"function": "no_such"}}])


def test_volume_log(spark):
    from orelake.operators import monitor

    log = spark.createDataFrame([], "run_ts timestamp, table_name string, total_rows long, new_rows long")
    for day, n in ((1, 100), (2, 130), (3, 130)):
        log = monitor.logged(log, "fact", spark.createDataFrame([(n,)], "total_rows long"), f"2026-01-0{day} 00:00:00")
    assert [r.new_rows for r in log.orderBy("run_ts").collect()] == [100, 30, 0]


def test_whole_texts(spark, tmp_path):
    (tmp_path / "docs" / "deep").mkdir(parents=True)
    (tmp_path / "docs" / "a.md").write_text("---\ntitle: A\n---\n# One\n\ntext\n")
    (tmp_path / "docs" / "deep" / "b.md").write_text("")
    (tmp_path / "docs" / "c.txt").write_text("no")
    got = {r.doc_path.rsplit("/", 1)[1]: (r.text, r.size) for r in files.whole_texts(spark, str(tmp_path / "docs")).collect()}
    assert got["a.md"][0].startswith("---\ntitle: A\n---\n") and got["a.md"][1] == (tmp_path / "docs" / "a.md").stat().st_size and "c.txt" not in got


def test_request_record_and_log(spark):
    from orelake.operators import retrieve

    kind = "request_id string, question string, answer string, prompt_tokens int, completion_tokens int, latency_ms int, chunks array<struct<chunk_id:string,doc_path:string,score:double>>"
    asked = spark.createDataFrame([("1", "q", f"{retrieve.ABSTAIN}", 1, 2, 3, None), ("2", "q", "It is so [2][7].", 1, 2, 3, [("c1", "a", 0.5), ("c2", "b", 0.25)])], kind)
    log = retrieve.logged(retrieve.record(asked, "small", 2, model="m", where={"doc_path": "a"}))
    assert log.columns == ["request_id", "logged_at", "user_name", *retrieve.RECORD[1:]]
    one, two = log.orderBy("request_id").collect()
    assert one.abstained and one["mode"] == "no_rag" and one.top_k is None and one.filters is None and one.retrieved_ids == [] and one.cited_docs == []
    assert not two.abstained and two.top_k == 2 and two.filters == '{"doc_path": "a"}' and two.scores == [0.5, 0.25] and two.cited_docs == ["b"]
