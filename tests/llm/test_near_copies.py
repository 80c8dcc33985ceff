"""The near-dedup stage against brute-force Jaccard similarity."""

import corpus_pipeline
from factloom.llm import near_copies


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_jaccard(rows):
    sets = [(i, _shingles(t)) for i, t in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                part[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return sorted(i for n, (i, _) in enumerate(sets) if i is not None and least[find(n)] == i)


def _corpus():
    words = [f"w{n}" for n in range(4000)]
    rows, n = [], 0
    for start in range(0, 3000, 250):
        text = words[start : start + 120]
        for changed in (0, 1, 2, 3, 4, 5, 6):  # each change takes five shingles: similarity from above to below 0.8
            t = list(text)
            for k in range(changed):
                t[10 + 17 * k] = f"x{n}{k}"
            n += 1
            rows.append((1000 - n, " ".join(t)))
    passage = " ".join(words[3500:3560])
    rows += [(2000 + k, passage + " " + " ".join(f"p{k}q{j}" for j in range(14 + k))) for k in range(4)]
    long = [f"l{n}" for n in range(90_000)]  # more members than a byte a bin holds
    rows += [(3000, " ".join(long)), (3001, " ".join([*long[:45_000], "x", *long[45_000:]]))]
    return [*rows, (1, "a b c"), (2, "A  b\nc"), (3, ""), (4, None), (None, rows[0][1]), (5, rows[0][1].upper())]


def test_stage_is_brute_force(spark):
    rows = _corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(i for i in out if i is not None) == kept_by_jaccard(rows) and out.count(None) == 1


def test_order_of_members_does_not_matter(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    rows = _corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = [r.doc_id for r in near_copies.near_copy_dedup(spark, docs).collect()]
    assert sorted(i for i in out if i is not None) == kept_by_jaccard(rows)


def test_links_through_rows_without_an_id(spark):
    text = [f"w{n}" for n in range(100)]
    middle, last = ["m", *text[1:]], ["m", "n", "o", "p", "q", *text[5:-10], *(f"z{n}" for n in range(10))]
    rows = [(1, " ".join(text)), (None, " ".join(middle)), (2, " ".join(last))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r.doc_id for r in near_copies.near_copy_dedup(spark, docs).collect() if r.doc_id is not None] == kept_by_jaccard(rows)


def test_groups_of_near_copies_are_not_compared_pair_by_pair(spark, monkeypatch):
    words = [f"w{n}" for n in range(300)]
    rows = []
    for n in range(400):  # each a little different from every other
        t = list(words)
        t[(7 * n) % 290], t[(13 * n + 5) % 290] = f"x{n}", f"y{n}"
        rows.append((n, " ".join(t)))
    rows += [(1000 + n, " ".join(f"v{n}z{k}" for k in range(80))) for n in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    compared = []
    verified = near_copies._verified

    def counted(spark, docs, marked, nodes, pairs):
        compared.append(pairs.count())
        return verified(spark, docs, marked, nodes, pairs)

    monkeypatch.setattr(near_copies, "_verified", counted)
    out = sorted(r.doc_id for r in near_copies.near_copy_dedup(spark, docs).collect())
    assert out == kept_by_jaccard(rows) == [0, *range(1000, 1050)]
    assert sum(compared) < 400 * 399 / 2 / 4


def test_columns_and_empty_tables(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, node string")
    out = near_copies.near_copy_dedup(spark, docs)
    assert out.columns == docs.columns and sorted(map(str, (r.doc_id for r in out.collect()))) == ["1", "None"]
    assert near_copies.near_copy_dedup(spark, docs.limit(0)).count() == 0


def test_texts_meet_by_fingerprints_on_the_grid_first(spark, monkeypatch):
    words = [f"w{n}" for n in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:1500], "x", *words[1500:]])), (3, " ".join(f"v{n}" for n in range(3000)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    nodes = near_copies._nodes(docs.withColumnRenamed("doc_id", "id"), *near_copies._frequent(docs)).collect()
    assert [0 < (a.fp ^ b.fp).bit_count() <= 2 for a, b in ((nodes[0], nodes[1]), (nodes[0], nodes[2]))] == [True, False]

    def none(spark, docs, marked, nodes, shared, n):
        return spark.createDataFrame([], "u bigint, v bigint, pu bigint, pv bigint"), shared, True

    monkeypatch.setattr(near_copies, "_round", none)
    assert sorted(r.doc_id for r in near_copies.near_copy_dedup(spark, docs).collect()) == kept_by_jaccard(rows) == [1, 3]


def test_a_shared_passage_alone_makes_no_pairs(spark, monkeypatch):
    """Texts with so many words of their own that what is left from their first shared member on cannot reach 0.8."""
    passage = " ".join(f"w{n}" for n in range(85))
    rows = [(n, passage + " " + " ".join(f"x{n}y{k}" for k in range(15))) for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    compared, verified = [], near_copies._verified

    def counted(spark, docs, marked, nodes, pairs):
        compared.append(pairs.count())
        return verified(spark, docs, marked, nodes, pairs)

    monkeypatch.setattr(near_copies, "_verified", counted)
    assert sorted(r.doc_id for r in near_copies.near_copy_dedup(spark, docs).collect()) == kept_by_jaccard(rows)
    assert sum(compared) < 60
