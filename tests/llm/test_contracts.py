"""The registered queries against brute-force versions of their contracts, on a small table; empty tables; clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

from pathquery.llm import langid, pii
from pathquery.llm import queries as Q

P = pytest.importorskip("public_tokenizers")
LANGS = {"en": "the of and to in that with was for", "de": "der die und das mit nicht auch über", "fr": "le la les des être avec où très"}
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5


def lowered(text):
    return SPACE.findall((text or "").encode().lower())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = []
    for i in range(150):
        lang = r.choice(list(LANGS))
        vocab = LANGS[lang].split()
        out.append((i, " ".join(r.choice(vocab) for _ in range(r.randint(5, 60))), lang))
    out += [(200, None, "en"), (201, "", None), (202, " \t\n", "en"), (203, "123 456 !!", "en"), (204, out[0][1], out[0][2]), (205, out[0][1].upper(), "en"), (206, "a\x00b \x1c É é", "fr"), (207, "word " * 3000, "en"), (208, "one", "en"), (209, "one two", "en"), (210, out[3][1] + " more", out[3][2])]
    pii_text = "Mail a.b+c@x-y.org, 10.0.0.255 and 10.0.0.256; +49 (30) 1234-5678, 4111 1111 1111 1111 x 4111 1111 1111 1112 é@é.de 1.2.3.4.5.6 a@b"
    return out + [(220, pii_text, "en"), (221, "é" * 50 + pii_text[::-1] + pii_text, None), (222, "12 " * 40, "en")]


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('sf')}"
    # columns of documents and others under names that operators use
    spark.createDataFrame([(*x, "s", len(x[1] or ""), "c", 0.5, 1, "k") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, n_email int, row_hash string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, rows[1][1]), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_op1_base(spark, rows, sf):
    count, tokens = Counter(), {i: lowered(t) + [None] for i, t, _ in rows}
    for i, w in tokens.items():
        if fold(i) != 1:
            count.update(w)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in Q.op1_ppm(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, w in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i) == 1, len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) and r.score < 0


def test_op3_held_out(spark, rows, sf):
    got = {r.doc_id: r for r in Q.op3_langid(spark, sf).collect()}
    assert len(got) == len(rows) and all(r.held_out == (fold(i) == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert all(got[i].lang_pred == "und" for i in (200, 201, 202, 203, 222))
    held = [(i, lang) for i, _, lang in rows if i < 150 and fold(i) == 0]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.95 * len(held) > 10


def test_op3_many_languages(spark):
    """More languages than one word of the filter holds."""
    alphabet = [chr(0x4E00 + 40 * i + j) for i in range(90) for j in range(40)]
    word = lambda i, k: "".join(alphabet[40 * i + (k * m) % 40] for m in (1, 3, 7, 11))
    train = spark.createDataFrame([(i * 10 + k, " ".join(word(i, k + m) for m in range(20)), f"l{i:02d}") for i in range(90) for k in range(3)], "doc_id long, text string, lang string")
    f = langid.fit(train)
    assert len(f.languages) == 90 and f.predict([word(i, 5) for i in range(90)])[0] == [f"l{i:02d}" for i in range(90)]


def test_op6_all_columns(spark, rows, sf):
    def print_of(text):
        w = lowered(text)
        s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0

    fp = {i: print_of(t) for i, t, _ in rows}
    up = {i: i for i in fp}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op6_simhash(spark, sf).collect()}
    assert got == {i: (f"{fp[i]:016x}", find(i)) for i in fp}


def test_op7_and_op9(spark, rows, sf):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    after = {}
    for i, t, _ in rows:
        text = t or ""
        for s, e, new in Q.stated_edits(i, text):
            s = min(s, len(text))
            text = text[:s] + (new or "") + text[max(s, min(e, len(text))) :]
        after[i] = len(coder.encode_ordinary(text))
    ids = {i: coder.encode_ordinary(t or "") for i, t, _ in rows}
    got = {r.doc_id: (r.n_tokens, r.n_tokens_after) for r in Q.op7_token_trees(spark, sf).collect()}
    assert got == {i: (len(ids[i]), after[i]) for i in ids}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op9_bpe(spark, sf).collect()}
    assert got == {i: (len(ids[i]), sha(" ".join(map(str, ids[i])).encode()), sha((t or "").encode())) for i, t, _ in rows}


def test_op10_all_columns(spark, rows, sf):
    digits = lambda m: re.sub(r"[^0-9]", "", m)
    kinds = {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))), "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)}
    got = {r.doc_id: r for r in Q.op10_pii(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        found = sorted((m.start(), n, k, m.end()) for n, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, t or "") if ok(m[0]))
        spans = [f"{k}:{s}:{e}" for s, _, k, e in found]
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[2] == k for x in found) for k in kinds)
        assert set(spans) <= set(r.spans.split(","))


def test_pipeline_clashing_columns(spark, rows, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        kept = {r.doc_id: r for r in out.collect()}
        if name == "language":
            assert {200, 201, 202, 203, 222}.isdisjoint(kept) and all(kept[i].lang_pred == "c" and kept[i].score == 0.5 for i in kept)
        elif name == "near_duplicates":
            assert {204, 205, 201, 202}.isdisjoint(kept) and {0, 3, 200, 206, 207, 208, 209} <= set(kept)
        elif name == "decontamination":
            assert 1 not in kept and {0, 200, 201} <= set(kept)
        else:
            assert kept[220].n_chars == len(kept[220].text) and "[email]" in kept[220].text and kept[220].n_email == 1 and kept[200].text is None
        empty = stage(spark, docs.limit(0), sf)
        assert empty.columns == docs.columns and empty.count() == 0
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert {0, 208} <= set(got) and {1, 200, 204, 205}.isdisjoint(got)


def test_empty_tables(spark, tmp_path):
    at = f"file://{tmp_path}"
    kinds = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "embeddings": "vec_id long, embedding array<float>", "pages": "page_id long, url string, html string", "benchmark": "item_id long, text string"}
    for name, kind in kinds.items():
        spark.createDataFrame([], kind).write.parquet(f"{at}/{name}.parquet")
    for name, query in Q.QUERIES.items():
        assert query(spark, at).count() == 0, name
