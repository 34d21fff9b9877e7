import json

from pyspark.sql import functions as F

from threadloom import plans, providers
from threadloom.sources import files, mail, sinks

RULE, DASH = "=" * 40, "-" * 40


def test_thread_files(spark, tmp_path):
    body = f"﻿Client: c@x.test\nMessages: 3\n\n{RULE}\n[CLIENT -> MANAGER]  (m)\nSubject: A long\n subject\nFrom: c@x.test\nTo: m@y.test\nDate: Mon, 05 Jan 2026 10:00:00 +0300\n{DASH}\nHow much?\n\n{RULE}\n[MANAGER -> CLIENT]\nDate: soon\nSubject: Re\n{DASH}\nNine.\n\n{RULE}\nno dash rule\n"
    (tmp_path / "t1.txt").write_text(body)
    rows = files.thread_messages(spark, str(tmp_path)).orderBy("index").collect()
    assert [(r.thread, r.client, r.role, r.subject, r.text, r.ts is None) for r in rows] == [("t1", "c@x.test", "client", "A long subject", "How much?", False), ("t1", "c@x.test", "manager", "Re", "Nine.", True)]
    assert [(r.declared, r.parsed) for r in files.thread_warnings(spark, str(tmp_path)).collect()] == [(3, 2)]


def test_faq_csv(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text('﻿number;theme;theme_label;frequency;languages;question;question_original;answer;variants\n1;a;A;;"en, ru";"How; much?";o;"Line\n""two""";v\n2;a;A;3;en;;o;x;v\n')
    rows = files.faq(spark, str(p)).collect()
    assert [(r.id, r.language, r.text, r.extra["frequency"]) for r in rows] == [("faq__0001", "en", 'Q: How; much?\nA: Line\n"two"', "0")]


def test_chunks_with_defaults_and_missing_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"id":"a","text":"two words"}\nnot json\n')
    rows = files.all_chunks(spark, str(tmp_path / "c.json"), str(tmp_path / "no.csv"), str(tmp_path / "no.json")).collect()
    assert [(r.id, r.source, r.word_count, r.low_signal) for r in rows if r.id] == [("a", "mailbox_thread", 2, False)]


def test_chat_export(spark, tmp_path):
    m = lambda i, **x: {"id": i, "type": "message", "from": "A", "from_id": "u1", "date_unixtime": "0", "text": "", **x}
    chat = {"id": 5, "name": "n", "type": "personal_chat", "messages": [m(1, text="hi"), m(2, type="service"), m(3, media_type="sticker"), m(4, media_type="voice_message", from_id="co"), m(5, text=["x", {"type": "bold", "text": "y"}])]}
    p = tmp_path / "e.json"
    p.write_text(json.dumps({"chats": {"list": [chat, {**chat, "id": 6, "type": "saved"}]}}))
    rows = files.chat_messages(spark, str(p), "co").orderBy("index").collect()
    assert [(r["index"], r.role, r.body) for r in rows] == [(1, "client", "hi"), (2, "manager", "[voice]"), (3, "client", "xy")]
    assert files.chat_company(spark, str(p)).first()["from_id"] in ("co", "u1")


def test_crm(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"results": {"deal_search": {"body": {"clients": [{"id": 1, "name": "n", "deals_for_event": [{"id": 7, "title": "t"}]}, {"id": 2, "deals_for_event": None}]}}}}))
    assert [(r.client_id, r.id) for r in files.crm_deals(spark, str(tmp_path / "d.json")).collect()] == [(1, 7)]
    (tmp_path / "c.json").write_text(json.dumps({"result": [{"id": 1, "name": "n", "contacts": [{"type_id": 2, "value": " A@b.co "}, {"type_id": 2, "value": "a@b.co"}, {"type_id": 2, "value": "bad"}, {"type_id": 1, "value": "+1"}]}]}))
    r = files.crm_clients(spark, str(tmp_path / "c.json")).first()
    assert (r.email, r.additional_emails, r.phone) == ("a@b.co", "", "+1")


def test_mail(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"From: C <c@mail.test>\r\nTo: m@corp.test\r\nSubject: =?utf-8?q?Caf=C3=A9?=\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>Hi &amp; bye</p><script>x</script>")
    (tmp_path / "b.eml").write_bytes(b"From: noreply@mail.test\r\nTo: m@corp.test\r\n\r\nauto")
    rows = mail.eml_messages(spark, str(tmp_path), ("corp.test",)).collect()
    assert [(r.direction, r.counterpart, r.subject, r.text) for r in rows] == [("incoming", "c@mail.test", "Café", "Hi & bye")]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, "x"), ("a", 1, "y" * 10)], "k string, n int, text string")
    sinks.sorted_json(df, str(tmp_path / "j"), ["k"])
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.append_csv(df, str(tmp_path / "c"), most=8)
    sinks.append_csv(df, str(tmp_path / "c"), most=8)
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 4
    assert sinks.copied(df, str(tmp_path / "p")) == 2
    assert sinks.markdown_table(df.orderBy("k")).splitlines()[2].startswith("| a | 1")
    sinks.count_manifest(df, "k", str(tmp_path / "m"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "m")).collect()) == ["1\ta", "1\tb"]
    official = tmp_path / "o"
    official.mkdir()
    (official / "A b.txt").write_text("hello")
    r = files.official_files(spark, str(official)).first()
    assert (r.chunk_id, r.file_path, r.text) == ("official__a-b", "A b.txt", "hello")
    assert files.allowed_users(spark, _written(tmp_path / "u.json", '{"allowed_user_ids": [1, 2, 2]}')).count() == 2


def _written(path, content):
    path.write_text(content)
    return str(path)


def test_providers_batch_retry_and_cache(spark):
    calls = []

    def flaky(batch):
        calls.append(len(batch))
        if len(calls) < 3:
            raise OSError
        return batch

    assert providers.Retrying(flaky, tries=3, sleep=lambda s: None)(["a"]) == ["a"] and len(calls) == 3
    df = spark.createDataFrame([(1, "One. Two."), (2, "One. Two."), (3, "known")], "id int, p string")
    cache = spark.createDataFrame([("known", "cached")], "prompt string, reply string")
    assert {r.id: r.reply for r in providers.completed(df, "p", providers.FirstSentence(), cache=cache).collect()} == {1: "One.", 2: "One.", 3: "cached"}


def test_retrieval_plan(spark):
    chunks = spark.createDataFrame([("a", "thread", "", "red apple fruit"), ("b", "official", "", "red apple rules"), ("c", "thread", "", "blue car")], "id string, source string, subject string, text string")
    points = plans.index_points(chunks)
    asked = spark.createDataFrame([(1, "red apple")], "query_id int, question string")
    rows = plans.retrieve(points, asked, k=2, slots=1, least=0.1).orderBy("rank").collect()
    assert [(r.id, r.reserved) for r in rows] == [("b", True), ("a", False)]
    assert plans.answers(points, asked, k=2).first()["answer"]


def test_sync_equals_rebuild(spark):
    snap = lambda rows: spark.createDataFrame(rows, "chunk_id string, content_sha256 string, text string")
    first, second = snap([("a", "1", "x"), ("b", "2", "y")]), snap([("b", "3", "z"), ("c", "4", "w")])
    embed = lambda df: providers.embedded(df, "text", providers.HashingEmbedder(16))
    got = plans.sync(embed(first), second, providers.HashingEmbedder(16)).orderBy("chunk_id").collect()
    assert got == embed(second).select(*embed(first).columns).orderBy("chunk_id").collect()


def test_map_reduce_and_faq(spark):
    items = spark.createDataFrame([(i, f"Note {i} here. Rest.") for i in range(6)], "id int, body string")
    rows = plans.map_reduce(items, "id", "body", budget=40).collect()
    assert len(rows) >= 1 and all(r.reply for r in rows)
    q = "How much does the standard relocation package cost this year?"
    a = "The standard relocation package costs 900 euros a year, which includes documents and translation."
    messages = spark.createDataFrame([("t", 0, "client", q), ("t", 1, "manager", a), ("u", 0, "client", q), ("u", 1, "manager", a + " More on request.")], "thread string, seq long, role string, text string")
    pairs = plans.question_pairs(messages)
    assert pairs.count() == 2
    assert plans.faq(pairs).select("frequency").first()["frequency"] == 2
    stats = plans.knowledge_base(messages, {"money": "euros"}, {"move": ("relocation",)})
    assert stats["channels"].first()["n"] == 2 and stats["totals"].first()["two_way"] == 2
    assert F is not None


def test_other_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.3, "t"), ("b", 0.1, "u")], "k string, ratio double, text string")
    sinks.contexts(df, "k", str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).count() == 2
    sinks.readable(df, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r"), wholetext=True).count() >= 1
    sinks.lowest(df, "ratio", 1, str(tmp_path / "l"))
    assert spark.read.csv(str(tmp_path / "l"), header=True).first()["k"] == "b"
    sinks.daily(df, F.lit("2026-01-01"), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2
    sinks.points(df.withColumn("source", F.lit("s")), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("source = 's'").count() == 2
    messages = spark.createDataFrame([("t1", 1, "client", "a"), ("t1", 2, "manager", "b")], "thread string, seq int, role string, text string")
    sinks.thread_files(messages, str(tmp_path / "t"))
    assert "[MANAGER]" in spark.read.text(str(tmp_path / "t"), wholetext=True).first()["value"]
    sinks.catalog_csv(spark.createDataFrame([("q", 2, ["v", "w"], "o" * 900)], "question string, frequency int, variants array<string>, question_original string"), str(tmp_path / "c"))
    row = spark.read.csv(str(tmp_path / "c"), header=True, sep=";").first()
    assert row["variants"] == "v | w" and len(row["question_original"]) == 800
    assert '"n"' in sinks.stats_json({"s": spark.sql("select 1 n")})


def test_faq_splits_loose_clusters_and_merges_representatives(spark):
    name = lambda k: "q" + chr(97 + k // 26) + chr(97 + k % 26) + "x"
    faq = lambda questions: plans.faq(spark.createDataFrame([(i, 1, q, "answer", 1.0, 1.0) for i, q in enumerate(questions)], "pair_id long, thread long, question string, answer string, question_score double, answer_score double"))
    # each shares 4 of 7 words with the next (0.4), and few with others: one component of twelve, too loose to stay
    chain = [" ".join(name(3 * i + k) for k in range(7)) for i in range(12)]
    got = faq(chain).orderBy("cluster_id").collect()
    assert [r.frequency for r in got] == [1] * 12 and [r.cluster_id for r in got] == list(range(1, 13))
    # no token of the signatures in common, but 16 of 36 words of the questions
    shared = " ".join("z" + name(k) for k in range(16))
    long = [" ".join(c + name(k) for k in range(10)) + " " + shared for c in "ab"]
    assert faq(long).first().frequency == 2
