"""Each operator against brute force on a small corpus with edge rows, and on an empty table."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from factloom.llm import bpe, bwt, fingerprint, html_text, mixing, quality, repeats, secrets, simhash, wavelet
from factloom.llm.components import connected_components


def same(df, expected):
    got = Counter(tuple(r) for r in df.collect())
    want = Counter(expected)
    assert got == want, (list((got - want))[:3], list((want - got))[:3])


def empty(docs):
    return docs.limit(0)


# ---- quality rules


def _repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    return len({p for i, w in enumerate(windows) if n[w] > 1 for p in (i, i + 1, i + 2)})


def test_quality_counts(docs, clashing, rows):
    expected = []
    for ident, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = _repeats(words)
        expected.append((ident, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), n, len(words) < 50 or 100 * n > 50 * len(words)))
    columns = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    same(quality.quality_rules(docs).select(*columns), expected)
    same(quality.quality_rules(clashing).select(*columns), expected)
    assert quality.quality_rules(empty(docs)).count() == 0


def test_quality_verdicts(docs):
    got = {r.id: r for r in quality.quality_rules(docs, cleaned=True).collect()}
    assert all(got[100 + 10 * n].kept for n in range(12)) and all(got[400 + n].kept for n in range(6))
    assert not any(got[n].kept for n in (1, 2, 9, 504, 505, 506))
    assert got[100].text == got[102].text and got[504].lost_chars == got[504].word_chars


def test_many_failed_lines_take_time_in_proportion(spark):
    import time

    def run(n):
        lines = [f"{k} ### $$$ ***" if k % 2 else f"line {k} is prose, and it ends as prose does." for k in range(n)]
        df = quality.quality_rules(spark.createDataFrame([(1, "\n".join(lines))], "doc_id bigint, text string"), cleaned=True)
        began = time.perf_counter()
        assert df.first().text == "\n".join(x for k, x in enumerate(lines) if not k % 2)
        return time.perf_counter() - began

    run(10)
    assert run(40_000) < 20 * run(4000) + 2


def test_boilerplate_in_four_languages(spark):
    prose = "Some plain words make up this line, and more of them follow here."
    lines = ["Read more", "Lire la suite", "Mehr erfahren", "Leer más", "Alle Rechte vorbehalten.", "Todos los derechos reservados", "Home › News › Today › Here", prose]
    got = quality.quality_rules(spark.createDataFrame([(1, "\n".join(lines))], "doc_id bigint, text string"), cleaned=True).first()
    assert got.text == prose and got.n_failed_lines == len(lines) - 1


# ---- near-duplicates


def _components(rows):
    fps = {}
    for ident, text, *_ in rows:
        fps.setdefault(simhash.fingerprint_of(text), []).append(ident)
    names = list(fps)
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            if (names[a] ^ names[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for n, name in enumerate(names):
        ids = [i for i in fps[name] if i is not None]
        if ids:
            least[find(n)] = min([*ids, least.get(find(n), min(ids))])
    return [(i, f"{simhash.fingerprint_of(t):016x}", least.get(find(names.index(simhash.fingerprint_of(t))))) for i, t, *_ in rows]


def test_fingerprint_by_its_definition():
    text = "The quick brown Fox jumps over the lazy dog the quick brown"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    assert simhash.fingerprint_of(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint_of(None) == simhash.fingerprint_of(" \n") == 0


def test_simhash_components(spark, docs, clashing, rows):
    same(simhash.simhash_components(spark, docs).select("id", "fingerprint", "component_id"), _components(rows))
    same(simhash.simhash_components(spark, clashing).select("id", "fingerprint", "component_id"), _components(rows))
    assert simhash.simhash_components(spark, empty(docs)).count() == 0
    kept = {r.doc_id for r in simhash.simhash_dedup(spark, docs).collect()}
    assert kept == {i for i, _, c in _components(rows) if i is None or i == c}


def test_grid_finds_every_pair_within_two_bits(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    points = {int(c) for c in centres}
    for c in centres.tolist():
        for _ in range(12):
            x = c
            for b in rng.integers(0, 64, 3).tolist():
                x ^= 1 << b
            points.add(x)
    points = sorted(points | {0, 1, 3, 2**64 - 1, 2**63})
    want = {tuple(sorted((a, b))) for n, a in enumerate(points) for b in points[:n] if (a ^ b).bit_count() <= 2}
    signed = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in points], "fp bigint")
    got = {tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in simhash.grid_links(signed).collect()}
    assert got == want


def test_cells_are_not_broadcast(spark):
    """Spark sizes the cells of a point as the point: by that size it would send them all through the driver."""
    points = spark.range(20).withColumnRenamed("id", "fp")
    found = simhash.grid_links(points)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() > 0


def test_fingerprints_that_only_rows_without_an_id_hold_link_others(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, i, t, s: docs.select(F.col(i).alias("id"), F.when(F.col(t) == "a", 0).when(F.col(t) == "b", 3).otherwise(15).cast("bigint").alias("fp")))
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "doc_id bigint, text string")
    assert {r.id: r.component_id for r in simhash.simhash_components(spark, rows).collect()} == {1: 1, None: 1, 2: 1}


def test_components_of_chains_and_stars(spark):
    edges = [(n, n + 1) for n in range(60)] + [(100, 100 + n) for n in range(1, 30)] + [(7, 7), (None, 3), (200, 199)]
    got = {r.node: r.component for r in connected_components(spark, spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{n: 0 for n in range(61)}, **{100 + n: 100 for n in range(30)}, 199: 199, 200: 199}
    assert connected_components(spark, spark.createDataFrame([], "u bigint, v bigint")).count() == 0
    hub = spark.createDataFrame([(5, 10 + n) for n in range(3000)] + [(9, 10)], "u bigint, v bigint")
    assert {r.component for r in connected_components(spark, hub).collect()} == {5}


# ---- secrets


def _secret_spans(text):
    out = []
    for n, r in enumerate(secrets.RULES):
        out += [(m.start(), n, r.kind, m.end()) for m in re.finditer(r.regex, text) if len(m[r.group]) >= r.least]
    return tuple(sorted(out))


def test_secret_spans(docs, clashing, rows):
    expected = [(i, _secret_spans(t or "")) for i, t, *_ in rows]
    for d in (docs, clashing):
        got = Counter((r.id, tuple(tuple(s) for s in r.spans)) for r in secrets.secret_spans(d).collect())
        assert got == Counter(expected)
    assert secrets.secret_spans(empty(docs)).count() == 0
    assert {k for _, s in expected for _, _, k, _ in s} >= {"assign", "access", "hex", "github"}


def test_failing_matches_use_up_their_text(spark):
    rows = [(1, "secret: token: abcdefg"), (2, "secret: abcdef token=éabcdefgh"), (3, 'PASSWORD"  :  \'abcdef\' ' * 50)]
    got = {r.id: [tuple(s) for s in r.spans] for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: list(_secret_spans(t)) for i, t in rows} and not got[1] and len(got[3]) == 50


def test_many_matches_take_time_in_proportion(spark):
    import time

    def run(n):
        text = "é token=abcdef12 and AKIA" + "A" * 16 + " 0123456789abcdef01234567\n"
        df = secrets.secret_spans(spark.createDataFrame([(1, text * n)], "doc_id bigint, text string"))
        began = time.perf_counter()
        row = df.select("spans", secrets.redacted(F.col("text"), secrets.key_blocks(F.col("text"), F.col("spans"))).alias("t")).first()
        assert row.t == "é [SECRET] and [SECRET] [SECRET]\n" * n
        if n <= 2000:
            assert tuple(tuple(x) for x in row.spans) == _secret_spans(text * n)
        assert len(row.spans) == 3 * n
        return time.perf_counter() - began

    run(10)
    assert run(20_000) < 20 * run(2000) + 2


def test_redaction_of_overlaps(spark):
    shape = "t string, s array<struct<start:bigint,number:int,kind:string,end:bigint>>"
    cases = [("0123456789" * 200, [(0, 0, "a", 3), (2, 1, "a", 5), (5, 0, "a", 6), (600, 0, "a", 1300), (700, 1, "b", 800), (1999, 0, "a", 2000)]), ("🙂é" * 600, [(1, 0, "a", 2), (511, 0, "a", 513)]), ("", []), ("x", [(0, 0, "a", 1)])]

    def plain(t, spans):
        out, at = [], 0
        for a, _, _, b in sorted(spans):
            if a >= at:
                out += [t[at:a], "[SECRET]"]
            at = max(at, b)
        return "".join(out) + t[at:]

    got = [r.x for r in spark.createDataFrame(cases, shape).select(secrets.redacted(F.col("t"), F.col("s")).alias("x")).collect()]
    assert got == [plain(t, x) for t, x in cases]


def test_trigram_queries_hold_for_every_match():
    q = secrets.trigram_query(secrets.RULES[0].regex)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        assert any(all(g in word for g in s) for s in q)
    assert secrets.trigram_query("[0-9a-f]+") is None and secrets.trigram_query("(abc|x)") is None
    assert secrets.trigram_query("abc?def") == [frozenset({"abd", "bde", "def"}), frozenset({"abc", "bcd", "cde", "def"})] or len(secrets.trigram_query("abc?def")) == 2


def test_redaction(spark):
    df = secrets.secret_spans(spark.createDataFrame([(1, "a token=abcdef12 b AKIA" + "A" * 16), (2, "clean")], "doc_id bigint, text string"))
    got = {r.id: r.t for r in df.select("id", secrets.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {1: "a [SECRET] b [SECRET]", 2: "clean"}


# ---- mixing


def test_mix(spark, docs, clashing):
    target = mixing.Target(max_repeat=2.0)
    uses = mixing.mix(spark, docs, target).collect()
    per = {}
    for u in uses:
        per.setdefault(u.source, []).append(u)
    tokens = {s: sum(u.n_tokens for u in us if u.epoch == 0) for s, us in per.items()}
    largest = max(tokens.values())
    assert {(r.doc_id, r.source) for r in docs.collect()} == {(u.id, u.source) for u in uses if u.epoch == 0}
    for s, us in per.items():
        assert len({(u.id, u.epoch) for u in us}) == len(us)
        if tokens[s]:
            assert us[0].budget <= 2 * tokens[s] + 1
            longest = max(u.n_tokens for u in us)
            assert us[0].budget <= sum(u.n_tokens for u in us) <= us[0].budget + longest
            if tokens[s] == largest:
                assert us[0].budget == tokens[s]
    assert max(u.budget / tokens[u.source] for u in uses if tokens[u.source]) > 1.9
    assert Counter(map(tuple, mixing.mix(spark, clashing, target).collect())) == Counter(map(tuple, uses))
    assert mixing.mix(spark, empty(docs), target).count() == 0
    times = Counter((u.id, u.source) for u in uses)
    assert mixing.mixed_documents(spark, docs, target).count() == sum(times[r.doc_id, r.source] for r in docs.collect())


def test_exponents(spark):
    shares = spark.createDataFrame([(1000,), (100,), (10,)], "tokens bigint")
    a = mixing.find_exponent(shares, mixing.Target(max_repeat=10.0))
    assert abs(100 ** (1 - a) - 10) < 1e-3
    a = mixing.find_exponent(shares, mixing.Target(min_entropy=1.0))
    w = np.array([1000.0, 100, 10]) ** a
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 1.0) < 1e-4


# ---- tokens


def test_bpe_is_the_library(spark, docs, rows, tokenizer):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer)
    enc = lambda t: lib.encode(t or "", add_special_tokens=False).ids
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = [(i, len(e), sha(np.array(e, "<u4").tobytes()), sha(lib.decode(e, skip_special_tokens=False).encode())) for i, t, *_ in rows for e in [enc(t)]]
    same(bpe.bpe_digests(spark, docs, tokenizer), expected)
    round_trip = {(r.id, bytes(r.ids), r.decoded) for r in bpe.bpe_roundtrip(spark, docs, tokenizer).collect()}
    assert round_trip == {(i, np.array(enc(t), "<u4").tobytes(), lib.decode(enc(t), skip_special_tokens=False)) for i, t, *_ in rows}
    assert bpe.bpe_digests(spark, empty(docs), tokenizer).count() == 0


def test_bpe_on_odd_texts(tokenizer):
    import random

    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(tokenizer), bpe.PrefixBPE(bpe.read_spec(tokenizer))
    r = random.Random(4)
    alphabet = "abcTHEaae 's 're'llÀé̈́中ßİſ½²🙂　\x1c\x00<|startoftext|><|endoftext|>\n\t.,!?##1234Σςǅﬁ̀가각"
    for _ in range(1500):
        s = "".join(r.choice(alphabet) for _ in range(r.randint(0, 50)))
        ids = lib.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == ids and own.decode(ids) == own.both(s)[1] == lib.decode(ids, skip_special_tokens=False)


def test_wavelet_shards(tmp_path):
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (700, 3), (5000, 49408), (1300, 1 << 20), (65_536, 9), (150_000, 1000)):
        tokens = rng.integers(0, top, n).astype(np.uint32)
        (tmp_path / "x.wvm").write_bytes(wavelet.build(tokens, np.array([n]), [None]))
        s = wavelet.Shard.open(str(tmp_path / "x.wvm"))
        assert s.ids == [None] and s.ends.tolist() == [n]
        assert (s.tokens() == tokens).all()
        for at in rng.integers(0, n, 20).tolist() if n else []:
            t = int(tokens[at])
            where = np.flatnonzero(tokens == t)
            assert s.access(at) == t and s.count(t) == len(where) and s.count(t, 10, at) == ((where >= 10) & (where < at)).sum()
            assert [s.locate(t, k) for k in range(min(3, len(where)))] == where[:3].tolist() and s.locate(t, len(where)) == -1
    assert wavelet.Shard(wavelet.build(np.array([1, 2]), np.array([2]))).count(1 << 30) == 0


def test_token_files(spark, docs, clashing, rows, tokenizer):
    from tokenizers import Tokenizer

    lib, at, expected = Tokenizer.from_file(tokenizer), 0, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    same(wavelet.token_files(spark, docs, tokenizer), expected)
    same(wavelet.token_files(spark, clashing, tokenizer), expected)
    assert wavelet.token_files(spark, empty(docs), tokenizer).count() == 0


def test_a_file_opens_block_by_block():
    tokens = np.random.default_rng(3).integers(0, 40_000, 1 << 19).astype(np.uint32)
    s = wavelet.Shard(wavelet.build(tokens, np.array([len(tokens)])))
    unpacked = []
    frame = s._frame
    s._frame = lambda level, block: unpacked.append(1) or frame(level, block)
    assert s.access(300_000) == tokens[300_000] and len(unpacked) <= s.levels


def test_token_files_in_a_store_without_mounted_folders(spark, docs, tokenizer, tmp_path, monkeypatch):
    expected = Counter(map(tuple, wavelet.token_files(spark, docs, tokenizer, str(tmp_path / "files")).collect()))
    assert len(list((tmp_path / "files").glob("*.wvm"))) == len({r.file for r in spark.read.parquet(str(tmp_path / "files" / wavelet.TABLE)).collect()}) > 0
    monkeypatch.setattr(wavelet, "_mounted", lambda *_: None)
    assert Counter(map(tuple, wavelet.token_files(spark, docs, tokenizer, str(tmp_path / "rows")).collect())) == expected
    assert not list((tmp_path / "rows").glob("*.wvm"))


def test_other_tokenizers_are_the_library_or_refused():
    import json

    import pytest

    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    spec = bpe.read_spec(public.path("byte_bpe_50k.json"))
    lib, own = Tokenizer.from_str(spec), bpe.PrefixBPE(spec)
    for text in ("Hello world, it's  42\n\nnew", " leading é 日本 🙂", "a  b   c\t", "", "don't stop"):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.both(text)[1] == own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    changes = [
        lambda d: d["model"]["vocab"].pop("a"), lambda d: d["model"].update(byte_fallback=True), lambda d: d["model"].update(ignore_merges=True),
        lambda d: d.update(pre_tokenizer={"type": "Whitespace"}), lambda d: d.update(added_tokens=[{"id": 1, "content": "x", "lstrip": True}]),
    ]
    for change in changes:
        data = json.loads(spec)
        change(data)
        with pytest.raises(bpe.UnsupportedTokenizer):
            bpe.PrefixBPE(json.dumps(data))


# ---- repeated strings


def _removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_repeated_strings(spark, docs, clashing, rows):
    some = [r for r in rows if len(r[1] or "") < 100_000]
    pick = F.coalesce(F.length("text"), F.lit(0)) < 100_000
    expected = [(r[0], *x) for r, x in zip(some, _removed([r[1] for r in some], 400))]
    same(repeats.repeated_strings(spark, docs.where(pick)), expected)
    same(repeats.repeated_strings(spark, clashing.where(pick)), expected)
    assert repeats.repeated_strings(spark, empty(docs)).count() == 0
    assert any(0 < x[2] < x[1] for x in expected)


def test_removed_spans_and_kept_bytes_are_returned(spark, tmp_path):
    from factloom.llm import queries

    passage = " ".join(f"word{n}" for n in range(100))
    n = len(passage)
    # é and © end in the same byte, which is repeated with the passage: what is kept is no text
    texts = ["é" + passage, "one ©" + passage + " tail", passage[:399], passage[1:401] + "." + passage[-400:], "", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = [[(1, n + 2)], [(5, n + 6)], [], [(0, 400), (401, 801)], [], []]
    kept = [b"\xc3", b"one \xc2 tail", passage[:399].encode(), b".", b"", b""]
    got = {r.id: r for r in repeats.without_repeats(spark, table).collect()}
    assert len(got) == 6 and all([tuple(s) for s in got[k].spans] == spans[k] and got[k].kept == kept[k] for k in range(6))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    expected = [(k, *x, ",".join(f"{a}:{b}" for a, b in spans[k])) for k, x in enumerate(_removed(texts, 400))]
    same(queries.op6_repeated_strings(spark, str(tmp_path)), expected)


def test_repeats_inside_one_long_text(spark):
    got = repeats.repeated_strings(spark, spark.createDataFrame([(1, "ab" * 5000), (2, "x" * 1_300_000)], "doc_id bigint, text string")).collect()
    assert {(r.id, r.n_removed, r.n_spans) for r in got} == {(1, 10_000, 1), (2, 1_300_000, 1)}


def test_merged_transforms_find_the_same_intervals():
    texts = [b"banana bandana", b"a banana split", b"", b"bandana band"]
    for length in (3, 5):
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = {(d, i) for d, t in enumerate(texts) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1}
        merged = bwt.merge([bwt.shard(texts[:2]), bwt.shard(texts[2:3], 2), bwt.shard(texts[3:], 3)], length)
        assert bwt.repeated_starts(merged) == want
        assert len(merged.open_rows) == length and merged.open_rows == sorted(merged.open_rows, reverse=True) and merged.open_rows[-1] >= len(want)


def test_shards_are_sorted_suffixes():
    for texts in ([b"banana", b"", b"anana", b"banana", b"\x00\xff\x00"], [b"aaaa" * 20], [b""], []):
        made = bwt.shard(texts, 5)
        suffixes = sorted((t[i:], n, i) for n, t in enumerate(texts) for i in range(len(t) + 1))
        assert [(5 + n, i) for _, n, i in suffixes] == list(zip(made.text.tolist(), made.start.tolist()))
        assert made.bwt.tolist() == [texts[n][i - 1] + 1 if i else 0 for _, n, i in suffixes]


# ---- pages


def test_tree_and_blocks():
    tree = html_text.train()
    assert all(html_text.classify(tree, r[:-1]) == r[-1] for r in html_text.LABELLED)
    page = """<html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><header><p>Site name</p></header>
      <nav><ul><li><a href="/x">Home</a><li><a href="/y">News</a></ul></nav><div class="ad">Buy this now.</div><article><h1>T &lt;1&gt;</h1>
      <p>First <b>para\n graph</b>&nbsp;here<br>on.<p>And second &amp; last.</p><aside>Related things</aside><div id="comments"><p>Reader says.</p></div>
      <form><p>Mail</p></form></article><div class="sidebar"><p>More words that look like prose but are none of it at all.</p></div><footer>&copy; x"""
    assert html_text.main_text(page, tree) == "T <1>\nFirst para graph here on.\nAnd second & last."
    assert html_text.main_text(None, tree) == html_text.main_text("", tree) == html_text.main_text("<nav>x</nav>", tree) == ""


def test_pages(spark):
    rows = [(1, "u", "<article><p>a b</p></article>", "old"), (2, None, None, None), (2, None, "", None), (None, "v", "<article>" + "<p>x</p>" * 20_000, "old")]
    got = sorted(map(tuple, html_text.extract_main_text(spark, spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()), key=repr)
    assert got == sorted([(1, "u", "a b", 3), (2, None, "", 0), (2, None, "", 0), (None, "v", "\n".join(["x"] * 20_000), 39_999)], key=repr)


# ---- fingerprints


def test_document_fingerprints(spark, docs, clashing, rows):
    def canon(t):
        return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split()).encode()

    line = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    expected = []
    for n, (i, t) in enumerate(line):
        following = line[(n + 1) % len(line)][1]
        e = fingerprint.edited(t, following)
        expected.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), xxhash.xxh3_128_hexdigest(canon(t)), xxhash.xxh3_128_hexdigest(canon(e)), float(canon(e) == canon(t)), float(canon(following) == canon(t))))
    columns = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    same(fingerprint.fingerprints_and_edits(spark, docs).select(*columns), expected)
    same(fingerprint.fingerprints_and_edits(spark, clashing).select(*columns), expected)
    assert fingerprint.fingerprints_and_edits(spark, empty(docs)).count() == 0
    assert fingerprint.edited("abcde", "x") == "abcx" and fingerprint.edited("abcde", "xyz") == "abcxy"
