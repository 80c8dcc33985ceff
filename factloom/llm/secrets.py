"""Secret scans by a trigram inverted index, as built-in SQL functions only.

A Boolean trigram query is derived from each rule's regex: a choice of alternatives, each a set of trigrams that
every match must contain. Posting lists are kept for the trigrams the queries name. They are cut into blocks of
documents of bounded size, so that a trigram of a third of all documents is many short lists. In each block the
lists of an alternative are intersected, alternatives are united, and the candidates that remain are verified
with the regex. A rule whose regex has no mandatory trigram scans every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm._arrays import blocks, greatest, let, piece, sums
from factloom.llm._common import no_null, staged

BLOCK_DOCS = 4096
#: So many candidates (some 4 MB) are broadcast at most.
BROADCAST_ROWS = 100_000
_MOST = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``regex`` whose group ``group`` has ``least`` characters or more.

    Regexes keep to what Java, RE2 and Python read alike, and match inside one line. The first three are the base.
    """

    kind: str
    regex: str
    group: int = 0
    least: int = 1


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])

RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
)
BASE = ("assign", "access", "hex")


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Alternatives of lower-case trigrams that any match contains; None: some match need contain none."""
    found = _alternatives(parser.parse(regex))
    sets = [frozenset(s[i : i + 3] for s in (*done, run) for i in range(len(s) - 2)) for done, run in found]
    return None if not all(sets) else [s for s in set(sets) if not any(o < s for o in sets)]


def _alternatives(nodes) -> list[tuple[tuple[str, ...], str]]:
    """(finished literal runs, open run) for each way through ``nodes``."""
    ways: list[tuple[tuple[str, ...], str]] = [((), "")]
    for op, arg in nodes:
        options = _options(op, arg)
        following = []
        for done, run in ways:
            for inner, tail, joined in options:
                # inner: runs inside the node, the first of which continues the open run when joined
                if not joined:
                    following.append(((*done, run, *inner), tail))
                elif inner:
                    following.append(((*done, run + inner[0], *inner[1:]), tail))
                else:
                    following.append((done, run + tail))
        if len(set(following)) > _MOST:  # too many ways: this node is taken as unknown, which only loosens the query
            following = [((*done, run), "") for done, run in ways]
        ways = list(dict.fromkeys(following))
    return ways


def _options(op, arg) -> list[tuple[tuple[str, ...], str, bool]]:
    unknown = [((), "", False)]
    if op is sre.LITERAL:
        return [((), chr(arg).lower(), True)]
    if op is sre.IN:
        if all(k is sre.LITERAL for k, _ in arg) and len(arg) <= 8:
            return [((), c, True) for c in dict.fromkeys(chr(v).lower() for _, v in arg)]
        return unknown
    if op is sre.SUBPATTERN:
        return _inner([arg[-1]])
    if op is sre.BRANCH:
        return _inner(arg[1])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        if (low, high) == (0, 1):
            return [((), "", True), *_inner([body])]
        if low:
            one = _alternatives(list(body) * min(low, 8))
            return [((*done, run), "", True) if (done or run) else ((), "", False) for done, run in one]
    return unknown


def _inner(bodies) -> list[tuple[tuple[str, ...], str, bool]]:
    out = []
    for body in bodies:
        out += [(done, run, True) for done, run in _alternatives(body)]
    return out


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, kind, end) of a rule's leftmost non-overlapping matches, in code points."""
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else whole
    shape = "struct<start:bigint,number:int,kind:string,end:bigint>"
    nothing = F.array().cast(f"array<{shape}>")

    def located(matches: Column) -> Column:
        """Matches and the pieces between them alternate; the running sums of their lengths are the positions."""
        pieces = F.transform(F.split(text, rule.regex, -1), lambda x: F.length(x).cast("bigint"))
        inside = F.transform(tested, F.length) if rule.group else F.transform(matches, F.length)

        def walk(sizes: Column, before: Column, least: Column) -> Column:
            steps = F.transform(sizes, lambda n, i: F.get(before, i) + n)
            spans = lambda ends: F.transform(ends, lambda e, i: F.struct((e - F.get(sizes, i)).alias("start"), F.lit(number).alias("number"), F.lit(rule.kind).alias("kind"), e.alias("end")))
            return let(sums(steps), lambda ends: F.filter(spans(ends), lambda s, i: F.get(least, i) >= rule.least)).cast(f"array<{shape}>")

        return let(F.transform(matches, lambda m: F.length(m).cast("bigint")), lambda sizes: let(pieces, lambda before: let(inside, lambda least: walk(sizes, before, least))))

    # splitting and locating only where a match is long enough
    return let(whole, lambda matches: F.when(F.size(matches) > 0, located(matches)).otherwise(nothing))


def _tight(rule: Rule) -> Rule:
    """A rule that is one character class repeated, with its least length inside the regex: fewer matches to look at."""
    if rule.regex == "[0-9a-f]+":  # a failing run holds no other match, since runs end where the class ends
        return Rule(rule.kind, "[0-9a-f]{%d,}" % rule.least)
    return rule


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, numbers): rules that a document may match by the trigram index; docs has columns key and text."""
    queries = {n: q for n, r in enumerate(rules) if (q := trigram_query(r.regex))}
    grams = sorted({g for q in queries.values() for s in q for g in s})
    blocks = max(1, docs.count() // BLOCK_DOCS)
    terms = F.array(*map(F.lit, grams))
    found = F.filter(terms, lambda g: F.contains(F.col("low"), g))
    postings = (
        docs.select("key", F.lower("text").alias("low"))
        .select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), "key", F.explode(found).alias("gram"))
        .groupBy("block", "gram")
        .agg(F.collect_set("key").alias("ids"))
    )
    lists = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("lists"))
    none = F.array().cast("array<bigint>")

    def posting(gram: str) -> Column:
        return F.coalesce(F.try_element_at("lists", F.lit(gram)), none)

    def answer(query: list[frozenset[str]]) -> Column:
        out = None
        for grams in query:
            hit = None
            for gram in sorted(grams):
                hit = posting(gram) if hit is None else F.array_intersect(hit, posting(gram))
            out = hit if out is None else F.array_union(out, hit)
        return out

    answers = F.array(*[F.struct(F.lit(n).alias("number"), answer(q).alias("ids")) for n, q in queries.items()])
    return (
        lists.select(F.explode(answers).alias("a"))
        .select(F.col("a.number").alias("number"), F.explode("a.ids").alias("key"))
        .groupBy("key")
        .agg(F.collect_set("number").alias("numbers"))
    )


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, text, spans) for every row: spans is an array of (start, number, kind, end) by start, then rule.

    Positions are code points, ends are exclusive. A null text is empty and has no spans. Repeated rows and null
    ids are each answered, an empty table gives no rows, other columns are not read, whatever their names.
    """
    kept = docs.select(F.col(id_col).alias("id"), no_null(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("key"))
    hits = staged(docs.sparkSession, candidates(kept.select("key", "text"), rules), "candidates")
    # few candidates are told to all texts; for more, texts and candidates are shuffled
    joined = kept.join(F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits, "key", "left")
    parts = []
    for n, rule in enumerate(rules):
        spans = _spans(F.col("text"), _tight(rule), n)
        if trigram_query(rule.regex):
            spans = F.when(F.array_contains("numbers", n), spans).otherwise(F.array().cast("array<struct<start:bigint,number:int,kind:string,end:bigint>>"))
        parts.append(spans)
    return joined.select("id", "text", F.array_sort(F.concat(*parts)).alias("spans"))


_KEY_MARK = r"-----(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY-----"
_KEY_HEADERS = r"^(?:\s*[A-Z][A-Za-z]*-[A-Za-z]+: [^\n]*){0,8}"
#: Where a run of base64 lines is over: a character of neither base64 nor what parts or quotes lines, or a short word.
_KEY_OVER = r"""[^A-Za-z0-9+/=\s"',>#*\\]|(?<![A-Za-z0-9+/=])(?![A-Za-z0-9+/=]{16})[A-Za-z0-9+/=]"""
_KEY_REST = r"""^[A-Za-z0-9+/]+={0,2}(?=[ \t"',]*(?:[\r\n\\]|$))"""


def key_blocks(text: Column, spans: Column) -> Column:
    """``spans`` with those of private keys drawn out from the header to the END line, or over the base64 lines if END is missing.

    A key ends before the next header at the latest, so each looks no further than that.
    """

    def unended(after: Column) -> Column:
        headers = F.regexp_extract(after, _KEY_HEADERS, 0)

        def run(body: Column) -> Column:
            lines = F.get(F.split(body, _KEY_OVER, 2), F.lit(0))
            whole = F.regexp_replace(lines, r"""[\s"',>#*\\]+$""", "")
            rest = F.length(F.regexp_extract(F.substring(body, F.length(lines) + 1, F.length(body)), _KEY_REST, 0))
            return F.when(F.length(whole) == 0, 0).otherwise(F.length(headers) + F.when(rest > 0, F.length(lines) + rest).otherwise(F.length(whole)))

        return run(F.substring(after, F.length(headers) + 1, F.length(after)))

    def length(after: Column) -> Column:
        ended = F.regexp_extract(after, _KEY_MARK, 1) == "END"
        upto = F.length(F.get(F.split(after, _KEY_MARK, 2), F.lit(0))) + F.length(F.regexp_extract(after, _KEY_MARK, 0))
        return F.when(ended, upto).otherwise(unended(after)).cast("bigint")

    def drawn(keys: Column, cut: Column) -> Column:
        # to the first character of the next header, which is in no key
        behind = lambda s, i: piece(cut, s["end"], F.least(F.coalesce(F.get(keys, i + 1)["start"] + 1, F.length(text).cast("bigint")), F.length(text).cast("bigint")))
        return F.transform(keys, lambda s, i: s.withField("end", s["end"] + let(behind(s, i), length)))

    others = F.filter(spans, lambda s: s["kind"] != "pem")
    keys = F.filter(spans, lambda s: s["kind"] == "pem")
    return F.when(F.exists(spans, lambda s: s["kind"] == "pem"), F.array_sort(F.concat(others, let(keys, lambda k: let(blocks(text), lambda cut: drawn(k, cut)))))).otherwise(spans)


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every stretch that spans cover replaced by ``mark``; spans that overlap are one stretch."""

    def cut_out(starts: Column, reach: Column, cut: Column) -> Column:
        # a span heads a stretch if it starts where all before it have ended, and the stretch ends where the next one's forerunners do
        heads = F.filter(F.transform(starts, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: (x["i"] == 0) | (x["s"] >= F.get(reach, x["i"] - 1)))

        def pieces(heads: Column) -> Column:
            kept = F.transform(heads, lambda x: piece(cut, F.when(x["i"] == 0, F.lit(0).cast("bigint")).otherwise(F.get(reach, x["i"] - 1)), x["s"]))
            return F.concat(kept, F.array(piece(cut, F.element_at(reach, -1), F.length(text).cast("bigint"))))

        return F.array_join(let(heads, pieces), mark)

    starts, ends = F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["end"])
    whole = let(starts, lambda s: let(greatest(ends), lambda r: let(blocks(text), lambda cut: cut_out(s, r, cut))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)
