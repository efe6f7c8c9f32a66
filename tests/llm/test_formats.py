"""Archives, chat windows and media: exact round trips."""

import hashlib
import random
import zlib

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from bytecairn.llm import chat, media, warc

from .conftest import edge_rows

PAGE = "<html>" + "payload of more than a hundred bytes " * 5 + "</html>"


def pages():
    rows = [(5, "http://a/5", PAGE), (3, "http://a/3", PAGE), (9, None, PAGE), (3, "http://a/3", PAGE), (None, "http://a/n", PAGE), (4, "http://a/4", "short"), (6, "http://a/6", "short"), (7, "http://a/\r\nX: y", None), (8, "http://é/ü", "é" * 60), (10, "u", "é" * 60), (None, None, None), (None, "q", "z" * 200)]
    rows += [(100 + i, f"http://b/{i}", f"<p>{i}</p>" + "text of a page " * (i % 50)) for i in range(300)]
    return rows


def brute_records(rows):
    least = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and page is not None:
            least[raw] = min(page, least.get(raw, page))
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        first = least.get(raw)
        revisit = first is not None and page != first
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 40_000)
    rows = pages()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, `first` string")
    path = str(tmp_path / "warc")
    warc.write_archives(warc.plan_records(df), path)
    got = warc.read_archives(spark, path, with_payload=True).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute_records(rows)
    assert {r["page_id"]: bytes(r["payload"]) for r in got if r["record_type"] == "response" and r["page_id"] == 8} == {8: ("é" * 60).encode()}
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)


def test_archive_starts_with_its_dictionary():
    records = [warc.format_record(i, f"http://h/{i}", (f"<p>{i}</p>" + "common words of many pages " * 20).encode(), None) for i in range(400)]
    content, index = warc.build_archive(records)
    assert content[:4] == (0x184D2A5D).to_bytes(4, "little") and index[0] > 8
    assert list(warc.read_archive(content, index)) == records
    assert len(content) < sum(map(len, records)) / 4
    assert list(warc.read_archive(content)) == records  # frames are told apart without the index
    assert list(warc.read_archive(content, index[5:8])) == records[5:8]
    few, _ = warc.build_archive(records[:1])
    assert few[:4] == content[:4] and list(warc.read_archive(few)) == records[:1]


def test_files_and_revisits(spark, tmp_path):
    """Archives as files, one record above the archive size among them, and revisits that get their response's payload."""
    long = "<p>" + "".join(chr(97 + i * i % 26) for i in range(warc.ARCHIVE_BYTES + 1000)) + "</p>"
    rows = [*pages()[:12], (77, "http://long", long), (78, "http://long/again", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(warc.plan_records(df), str(tmp_path / "table"))
    names = warc.export_files(spark, str(tmp_path / "table"), f"file://{tmp_path}/files").collect()
    assert sorted(f.name for f in (tmp_path / "files").iterdir() if not f.name.startswith(".")) == sorted(r["name"] for r in names)
    got = warc.resolve_revisits(warc.read_files(spark, f"file://{tmp_path}/files", with_payload=True)).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute_records(rows)
    assert all(hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"] for r in got)


def test_damage_is_noticed():
    record = warc.format_record(1, "u", b"payload", None)
    with pytest.raises(ValueError, match="does not match"):
        warc.parse_record(record.replace(b"payload\r\n", b"pAyload\r\n"))


def test_archives_of_nothing_and_sql(spark, data, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.plan_records(none), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    got = warc.op1_warc(spark, data)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({warc.SQL})").fetchall(), key=str)


@given(st.text(), st.text())
def test_turns_unescape_to_what_was_said(role, text):
    assert chat.parse_turns(chat.format_turn(role, text)[0]) == [(role, text)]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "Tool: x", ""]), st.text(alphabet="\\#</turn>: \nab", max_size=20)), max_size=8))
def test_many_turns_parse_back(turns):
    whole = "".join(chat.format_turn(r, t)[0] for r, t in turns)
    assert chat.parse_turns(whole) == turns


def conversations():
    rng = random.Random(8)
    rows = [(-1, 0, "user", None), (-1, 1, "assistant", None), (None, 0, "user", "no id"), (None, 1, "assistant", "none"), (-2, 0, None, "no role"), (-3, 0, "system", "only a system turn"), (-4, 0, "user", "same"), (-4, 0, "user", "same"), (-4, None, "assistant", "first"), (-5, 1, "assistant", "word " * 3000), (-5, 2, "system", "late system"), (-5, 3, "assistant", "end\\")]
    for c in range(20):
        rows += [(c, 0, "system", "be brief ### </turn>")] * (c % 2)
        rows += [(c, t, "user" if t % 2 else "assistant", " ".join(rng.choice(["aa", "### b", "</turn>", "\\", "ça"]) for _ in range(rng.randint(0, 60)))) for t in range(1, rng.randint(1, 30))]
    return rows


def brute_conversations(rows):
    by = {}
    null_first = lambda v: (v is not None, v if v is not None else 0)
    text_first = lambda v: (v is not None, (v or "").encode())
    for conv, turn, role, text in sorted(rows, key=lambda r: (null_first(r[1]), text_first(r[2]), text_first(r[3]))):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = []
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_conversations_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, `window` int")
    windows = chat.format_conversations(df, budget=120, history=40)
    got = chat.read_conversations(windows).collect()
    assert sorted(((r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got), key=str) == brute_conversations(rows)
    assert sum(r["formatted_chars"] for r in got) == sum(len(w["text"]) for w in windows.collect())


def test_very_long_texts_and_conversations(spark):
    """A turn of a megabyte of control strings, and a conversation of thousands of turns."""
    rows = [(1, 0, "user", "### </turn>\\ word " * 60_000), (1, 1, "assistant", "x" * 300_000)] + [(2, t, "assistant" if t % 2 else "user", f"turn {t} " * (t % 40)) for t in range(4000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.read_conversations(chat.format_conversations(df)).collect()
    assert sorted(((r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got), key=str) == brute_conversations(rows)


def test_token_counts_are_those_of_each_text(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(chat, "ENCODE_CHARS", 30)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(chat.VOCABULARY))
    texts = ["", "a b c", "word " * 20, "é" * 5, "x"]
    assert chat.token_counts(tokenizer, texts) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_windows_keep_budget_system_and_history(spark):
    rows = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(rows, budget=120, history=40).collect()
    for w in windows:
        turns = chat.parse_turns(w["text"])
        assert len(turns) == w["n_turns"] and w["oversize"] == (w["n_tokens"] > 120)
        if w["oversize"]:
            assert w["n_turns"] <= 2 and w["n_repeated"] <= 1
        if w["conv_id"] is not None and w["conv_id"] > 0 and w["conv_id"] % 2:
            assert turns[0][0] == "system"
        targets = [chat.unescape(w["text"][m["start"] : m["end"]]) for m in w["mask"]]
        assert targets == [t for r, t in turns[w["n_repeated"] :] if r == "assistant"]
    assert any(w["n_repeated"] > 1 for w in windows)


def test_chat_query_adds_the_control_conversation(spark, data):
    row = chat.op4_chat_format(spark, data).where("conv_id = -7").first()
    said = chat.CONTROL_TEXT
    assert row["n_turns"] == 2 and row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_conversations(chat.format_conversations(none)).count() == 0


HTML = """<article>Intro &amp; more<figure><img src="sha256:aa" alt="old"><figcaption>A <b>caption</b></figcaption></figure>
<script>var x = "<p>no</p>";</script><!-- no --><p>Middle</p><img src="http://h/x.png" alt="Alt"><video src=v.mp4 data-digest="bb"></video>End"""


def test_interleaving_keeps_order_and_captions():
    items = media.interleave_html(HTML)
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [
        (0, "text", "Intro & more", None, None), (1, "image", None, "aa", "A caption"), (2, "text", "Middle", None, None), (3, "image", None, None, "Alt"), (4, "video", None, "bb", None), (5, "text", "End", None, None),
    ]
    assert media.interleave_html(None) == [] and media.interleave_html("") == []
    assert media.interleave_html("<figure><figcaption>unclosed")[0]["text"] == "unclosed"
    nested = media.interleave_html("<title>no</title><figure><img src=a><figure><iframe src=b></iframe><figcaption>inner</figcaption></figure><img srcset='c 1x, d 2x'><figcaption>outer</figcaption></figure><noscript>no</noscript><object data=e></object>")
    assert [(i["kind"], i["src"], i["caption"]) for i in nested] == [("image", "a", "outer"), ("frame", "b", "inner"), ("image", "c", "outer"), ("object", "e", None)]


def test_resolution_aligns_positions(spark):
    pages = spark.createDataFrame([(1, HTML), (2, HTML), (3, None)], "page long, html string")
    store = spark.createDataFrame([("aa", "payload A"), ("cc", "unused")], "digest string, payload string")
    out = media.collect(media.resolve(media.interleave(pages), store, "page"), "page").collect()
    assert sorted((r["page"], len(r["items"])) for r in out) == [(1, 6), (2, 6), (3, 0)]
    for r in out[:]:
        if r["page"] == 3:
            continue
        assert [(i["position"], i["caption"], i["payload"]) for i in r["items"] if i["kind"] != "text"] == [(1, "A caption", "payload A"), (3, "Alt", None), (4, None, None)]


def slow_feature(payload):
    n = len(payload)
    mean = sum(payload) / n
    dev = max(0.0, sum(b * b for b in payload) / n - mean * mean) ** 0.5
    step = sum(abs(a - b) for a, b in zip(payload, payload[1:])) / max(1, n - 1)
    hist = [sum(b // 16 == k for b in payload) * 1000 // n for k in range(16)]
    return f"mean={mean:.3f};dev={dev:.3f};step={step:.3f};hist={','.join(map(str, hist))}"


def brute_media(rows):
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        stored = f"P5\n# bytes {len(raw)}\n192 {len(payload) // 192}\n255\n".encode() + payload
        out.append((doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), slow_feature(payload)))
    return sorted(out, key=str)


def test_texts_as_media(spark, edge, no_documents, data, monkeypatch):
    from pyspark.sql import functions as F

    def run(docs):
        monkeypatch.setattr(media, "table", lambda *a: docs)
        return media.op7_media_columns(spark, data).collect()

    got = run(edge.withColumn("digest", F.lit("x")))
    assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")) for r in got), key=str) == brute_media([(r[0], r[1]) for r in edge_rows()])
    twice = [r for r in got if r["doc_id"] in (1, 2)]
    assert len({tuple(r)[1:] for r in twice}) == 1
    assert run(no_documents) == []


def test_samples_round_trip():
    for n in (0, 1, 192, 500):
        raw = bytes(i % 256 for i in range(n))
        payload = raw + b" " * (-n % 192 if n else 192)
        assert media.decode_samples(media.encode_samples(payload, n)) == (payload, n)
    with pytest.raises(ValueError, match="missing"):
        media.decode_samples(media.encode_samples(b" " * 192, 0)[:-1])
