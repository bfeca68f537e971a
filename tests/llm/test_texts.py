from __future__ import annotations

import glob
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from rasterloom.llm import packing, pieces, warc

DOCS = "doc_id long, text string"
EDGE = [None, "", " ", " a  b ", "Hello, world.", "don't stop.,  a.b", "ÉCOLE é naïve ẞ İx ΟΔΟΣ", "日本語 ▁x\x00\t\n", "\U0001f600 ok", "x" * 3000, "the and " * 9000, "<|endoftext|> a<|endoftext|>,"]


def test_word_cache_gives_the_vocabulary_ids():
    tokenizers = pytest.importorskip("tokenizers")
    model = tokenizers.Tokenizer.from_file(packing.vocabulary_path())
    coder = packing.Encoder(packing.vocabulary_path())
    for t in EDGE:
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == model.encode(t or "", add_special_tokens=False).ids


def test_new_plain_words_take_their_ids_straight_from_the_model():
    """Only words that aren't plain go through the whole tokenizer; ids of odd words are its own."""
    tokenizers = pytest.importorskip("tokenizers")
    model = tokenizers.Tokenizer.from_file(packing.vocabulary_path())
    coder = packing.Encoder(packing.vocabulary_path())
    asked = []

    class Asked:
        def encode(self, text, add_special_tokens):
            asked.append(text)
            return model.encode(text, add_special_tokens=add_special_tokens)

    coder.model = Asked()
    r = np.random.default_rng(5)
    letters = np.array([*"abzA019.,-_<|>'[]{}!/@#~`^=+:;\x00\x1c\x7féÀßÿ÷×µªº²\u0301ñİΣσ日\xad\xa0"])
    words = ["Never12", "café.", "don't", "ÀÉß-9", *("".join(r.choice(letters, n)) for n in r.integers(1, 9, 3000))]
    for w in words:
        assert np.frombuffer(coder.encode(w), "<u4").tolist() == model.encode(w, add_special_tokens=False).ids
    assert asked and all(not packing._PLAIN(w) for w in asked) and "don't" in asked


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    r = np.random.default_rng(seed)
    lengths = np.minimum(r.lognormal(5, 1.2, 3000).astype(int) + 1, 2048)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    patterns = packing.plan(counts)
    used = {}
    for times, items in patterns:
        assert times > 0 and sum(items) <= 2048
        for x in items:
            used[x] = used.get(x, 0) + times
    assert used == counts
    assert sum(t for t, _ in patterns) <= -(-int(lengths.sum()) // 2048) + 1


def test_plan_finds_exact_complements():
    assert [sorted(p) for _, p in packing.plan({10: 1, 7: 1, 3: 1}, 10)] == [[10], [3, 7]]
    assert [sorted(p) for _, p in packing.plan({5: 2, 3: 1, 2: 1}, 10)] == [[5, 5], [2, 3]]
    assert [sorted(p) for _, p in packing.plan({6: 1, 2: 1, 1: 2}, 10)] == [[1, 1, 2, 6]]
    assert packing.plan({4: 5}, 10) == [(2, [4, 4]), (1, [4])] and packing.plan({}) == []


def test_packing_is_gapless_and_whole(spark):
    tokenizers = pytest.importorskip("tokenizers")
    model = tokenizers.Tokenizer.from_file(packing.vocabulary_path())
    rows = [(k, t) for k, t in enumerate(EDGE)] + [(4, EDGE[4]), (4, EDGE[4]), (None, "a b")] + [(100 + k, "word " * (k * 13 % 700)) for k in range(150)]
    got = packing.report(spark, spark.createDataFrame(rows, DOCS)).collect()
    want = []
    for k, t in rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(k, p, lo, len(ids[lo : lo + 2048]), zlib.crc32(ids[lo : lo + 2048].tobytes())) for p, lo in enumerate(range(0, len(ids), 2048))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert packing.report(spark, spark.createDataFrame([], DOCS)).count() == 0


@pytest.fixture(scope="module")
def coder():
    pytest.importorskip("sentencepiece")
    return pieces.Segmenter(pieces.vocabulary_path())


def every_score(coder, chunk):
    out = []

    def go(at, score):
        if at == len(chunk):
            out.append(score)
        for j in range(at + 1, len(chunk) + 1):
            s = coder.scores.get(chunk[at:j], coder.unknown if j == at + 1 else None)
            if s is not None:
                go(j, score + s)

    go(0, 0.0)
    return sorted(out, reverse=True)


@pytest.mark.parametrize("chunk", [" hello", "  theb", " thnedble", " \U0001f600x", "▁", ",.!", " 12"])
def test_n_best_against_all_paths(coder, chunk):
    assert [s for s, _ in coder.search(chunk, 4)] == every_score(coder, chunk)[:4]


@pytest.mark.parametrize("text", [t or "" for t in EDGE[:9]])
def test_n_best_of_texts(coder, text):
    ids, n, scores = coder.segment(text)
    best = coder.n_best_ids(text)
    assert scores == pytest.approx([s for s, _ in best]) and len(ids) == 4 * n
    assert all(coder.decode(np.array(x, "<u4").tobytes()) == text for _, x in best)
    if len(text) < 12:
        assert scores == pytest.approx(every_score(coder, " " + text if text else "")[:4])


def test_chunks_solved_together_equal_the_search(coder):
    r = np.random.default_rng(2)
    chunks = sorted({" " + "".join(r.choice(list("thenaed\u00e9\u4e00\U0001f600 "), int(n))) for n in r.integers(0, 14, 300)} - {" "})
    best, loss, count, ids = coder.lattices.solve(chunks)
    ends = np.cumsum(count)
    for k, chunk in enumerate(chunks):
        found = coder.search(chunk, 2)
        assert best[k] == pytest.approx(found[0][0])
        assert loss[k] == (pytest.approx(found[0][0] - found[1][0]) if len(found) > 1 else np.inf)
        if (own := ids[ends[k] - count[k] : ends[k]]).min() >= 0:
            assert own.tolist() == coder.encode_chunk(chunk, found[0][1])


def test_long_chunks_take_time_in_proportion(coder):
    text = "".join(np.random.default_rng(0).choice(list("thenadrs"), 100_000))
    began = time.process_time()
    ids, n, scores = coder.segment(text)
    assert coder.decode(ids) == text and len(scores) == 4 and time.process_time() - began < 10


def test_forgetting_changes_nothing(coder, monkeypatch):
    texts = [t or "" for t in EDGE[:9]]
    want = coder.segments(texts)
    monkeypatch.setattr(pieces, "REMEMBERED", 1)
    assert [coder.segments([t])[0] for t in texts] == want


def test_pieces_round_trip(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(EDGE)] + [(4, EDGE[4])], DOCS)
    coded = pieces.encode(spark, df)
    assert all(r.decodes for r in coded.collect())
    back = {r.doc_id: r.decoded for r in pieces.decode(spark, coded.select("doc_id", "ids")).collect()}
    assert back == {k: t or "" for k, t in enumerate(EDGE)}
    assert pieces.report(spark, df.limit(0)).count() == 0


class Reader(HTMLParser):
    BLOCKS = {"p", "div", "br", "li", "ul", "h1", "article", "nav"}

    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head")
        self.out += ["\n"] if tag in self.BLOCKS else []

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head")
        self.out += ["\n"] if tag in self.BLOCKS else []

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data.replace("\n", " "))


def parsed(page):
    r = Reader()
    r.feed(page)
    r.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(r.out).split("\n")) if x)


PAGE = '<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- no --><nav><ul><li><a href="/x">X</a></li><li><a href=\'y\'>Y</a></li></ul></nav><script>var t="</p>";</script><p>One<br>two &lt;3 caf&eacute;</p><div>a <b>b</b> c</div></body></html>'


def test_plain_text_against_a_parser():
    assert warc.plain(PAGE) == parsed(PAGE) == "X\nY\nOne\ntwo <3 café\na b c"


@pytest.mark.parametrize("unit", ["<a ", "<p", "<title>", "<a href=\"x", "<a href='", "<!", "<td ", "<script>", "</script ", "&#1", "&#x", "<a href", "<![", "<?x"])
def test_hostile_pages_take_time_in_proportion(unit):
    page = (unit * (1 + 1_000_000 // len(unit)))[:1_000_000]
    began = time.process_time()
    row = warc.response(1, "http://a/", page)
    warc.derive(row[0], row[2], row[3], row[4], row[5], row[8])
    assert time.process_time() - began < 4


def test_links_and_titles():
    page = "<a href=x><A title='t' HREF = \"a>b\">1</A><a>none</a><a href='y &amp; z'><title>T <b>1</b></title><title>2</title><a href=\"open>rest <a href=q>"
    assert warc.links_of(page) == ["x", "a>b", "y & z", "\"open", "q"] and warc.title_of(page) == "T 1"
    assert warc.title_of("<title>open") == warc.title_of("<title") == "" and warc.plain("&#" + "9" * 5000 + ";&#x" + "0" * 5000 + "41;") == "\ufffdA"
    assert warc.decode(b"abc", {"content-type": "text/html; charset=undefined"}) == "abc"


def test_warc_derivatives(spark, tmp_path):
    rows = [(1, "http://a/", PAGE), (2, None, None), (3, "http://b/", ""), (1, "http://a/", PAGE), (4, "http://c/", "plain < text & é" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    done = warc.derivatives(spark, warc.responses(spark, pages))
    warc.write(done, str(tmp_path / "w"))
    records = [r for f in glob.glob(str(tmp_path / "w" / "*.gz")) for r in warc.parse(open(f, "rb").read())]
    assert len(records) == 10
    source = {r.record_id: r for r in warc.responses(spark, pages).collect()}
    for head, block in records:
        assert head["warc-block-digest"] == warc.digest(block) and len(block) == int(head["content-length"])
        origin = source[head["warc-refers-to"]]
        assert head["warc-payload-digest"] == origin.payload_digest and head["warc-date"] == origin.date and head.get("warc-target-uri") == origin.target
    assert {h["warc-concurrent-to"] for h, _ in records if h["warc-type"] == "metadata"} == {h["warc-record-id"] for h, _ in records if h["warc-type"] == "conversion"}
    first = done.where("key = 1").first()
    assert (first.title, first.n_links, first.status) == ("A & B", 2, 200)
    assert warc.report(spark, pages.limit(0)).count() == 0


def test_warc_files_are_read(spark, tmp_path):
    row = warc.response(1, "http://a/", PAGE)
    raw = warc.serialise([("WARC-Type", "response"), ("WARC-Record-ID", row[0]), ("WARC-Target-URI", row[2]), ("WARC-Date", row[3]), ("WARC-Payload-Digest", row[5])], row[8])
    (tmp_path / "x.warc").write_bytes(raw + b"\r\n\r\n" + raw + b"\r\n\r\n")
    got = warc.derivatives(spark, warc.read(spark, str(tmp_path))).collect()
    assert len(got) == 2 and got[0].text == warc.plain(PAGE)
    for junk in (b"junk", b"WARC/1.1\r\nContent-Length: 3\r\n"):
        with pytest.raises(ValueError, match="no WARC record"):
            list(warc.parse(junk))


def test_n_best_ids_reach_the_query(spark, coder):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(EDGE[:9])], DOCS)
    for r in pieces.encode(spark, df).collect():
        text = EDGE[r.doc_id] or ""
        ids = [np.frombuffer(x, "<u4").tolist() for x in (r.ids, *r.alternatives)]
        assert len(ids) == len(r.scores) == len({tuple(x) for x in ids})
        assert all(coder.decode(np.array(x, "<u4").tobytes()) == text for x in ids)
        want = coder.n_best_ids(text)
        if len({round(s, 6) for s, _ in want}) == len(want):
            assert [x for x in ids[:-1]] == [x for _, x in want][:-1]
    for r in pieces.report(spark, df).collect():
        assert [x is not None for x in (r.ids_crc32, r.ids_crc32_2, r.ids_crc32_3, r.ids_crc32_4)] == [k < len(r.scores) for k in range(4)]


def test_warc_source_headers_are_kept(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nServer: x\r\nContent-Type: text/html\r\nSet-Cookie: a=1\r\nset-cookie: b=2\r\nLast-Modified: Mon,\r\n 1 Jan\r\nContent-Language: de\r\n\r\n<p>hi"
    head = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Truncated", "length"), ("WARC-Warcinfo-ID", "<urn:uuid:0>"), ("WARC-Identified-Payload-Type", "text/html")]
    (tmp_path / "x.warc").write_bytes(warc.serialise(head, block) + b"\r\n\r\n")
    records = warc.read(spark, str(tmp_path))
    kept = [(h.name, h.value) for h in records.first().headers]
    assert kept == [*((k.lower(), v) for k, v in head), ("content-length", str(len(block)))]
    (_, meta), = warc.parse(bytes(warc.derivatives(spark, records).first().metadata))
    lines = meta.decode().split("\r\n")
    for want in ("http-content-type: text/html", "http-server: x", "http-set-cookie: a=1", "http-set-cookie: b=2", "http-last-modified: Mon, 1 Jan", "http-content-language: de",
                 "source-warc-truncated: length", "source-warc-warcinfo-id: <urn:uuid:0>", "source-warc-identified-payload-type: text/html"):
        assert lines.count(want) == 1
