"""Line-first quality rules, as built-in SQL functions only.

Each line is judged alone by punctuation, navigation and boilerplate rules; lines that fail are removed; a
document that loses too much of its text, or that fails the base counts, is rejected. Every count is made inside
the document's own row by array functions, so there is no shuffle at all and long documents stay one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm._arrays import let
from factloom.llm._common import no_null

SYMBOLS = "#*$%&|<>"

#: Fixed phrases of pages' furniture, matched in lower case: English, French, German, Spanish.
BOILERPLATE = (
    *("all rights reserved", "cookie policy", "uses cookies", "accept cookies", "privacy policy", "terms of service", "terms of use", "enable javascript"),
    *("sign up for our newsletter", "subscribe to our", "click here", "read more", "share this", "skip to content", "back to top", "powered by", "lorem ipsum"),
    *("tous droits réservés", "politique de confidentialité", "politique de cookies", "utilise des cookies", "accepter les cookies", "mentions légales", "conditions d'utilisation"),
    *("abonnez-vous à", "inscrivez-vous à", "cliquez ici", "lire la suite", "en savoir plus", "retour en haut", "partager sur"),
    *("alle rechte vorbehalten", "datenschutzerklärung", "cookie-richtlinie", "verwendet cookies", "cookies akzeptieren", "nutzungsbedingungen", "impressum"),
    *("newsletter abonnieren", "jetzt abonnieren", "klicken sie hier", "hier klicken", "weiterlesen", "mehr erfahren", "nach oben", "artikel teilen"),
    *("todos los derechos reservados", "política de privacidad", "política de cookies", "utiliza cookies", "aceptar cookies", "aviso legal", "términos de uso"),
    *("suscríbete a", "suscríbase a", "haz clic aquí", "haga clic aquí", "leer más", "seguir leyendo", "volver arriba", "compartir en"),
)
#: Characters that part the items of menus and trails.
SEPARATORS = "|>»›•·→"


@dataclass(frozen=True)
class Rules:
    """Parameters of the line and document rules.

    A line fails punctuation when symbol characters exceed ``max_symbol_share`` of its word characters, or when it
    has ``prose_words`` words or more without any sentence punctuation. It fails navigation when at least
    ``min_separators`` separators stand between its words, one for every ``words_per_item`` words or more. It
    fails boilerplate when it holds a fixed phrase and has at most ``boilerplate_words`` words.
    """

    max_symbol_share: float = 0.1
    prose_words: int = 40
    min_separators: int = 3
    words_per_item: int = 4
    boilerplate_words: int = 30
    min_words: int = 50
    max_repeat_percent: int = 50
    max_lost_share: float = 0.5


def words_of(text: Column) -> Column:
    """The words of a text, in order; a split at one character needs no regex."""
    return F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), lambda w: w != "")


def _repeat_words(words: Column, size: int = 3) -> Column:
    """Words that lie in a window of ``size`` words found twice or more (the first occurrence counts too)."""
    n = F.size(words)

    def covered(found: Column) -> Column:
        """found: (window, position) in order; equal windows are neighbours."""
        repeated = F.filter(
            found,
            lambda e, i: (F.get(found, i - 1)["w"].eqNullSafe(e["w"])) | (F.get(found, i + 1)["w"].eqNullSafe(e["w"])),
        )
        starts = F.array_sort(F.transform(repeated, lambda e: e["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))
        return F.aggregate(
            starts,
            zero,
            lambda a, p: F.struct((p + size).alias("end"), (a["sum"] + size - F.greatest(F.lit(0), a["end"] - p)).cast("long").alias("sum")),
            lambda a: a["sum"],
        )

    def counted(windows: Column) -> Column:
        found = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(found, covered))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - size), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)]))

    return F.when(n < size + 1, F.lit(0).cast("long")).otherwise(let(words, lambda w: let(windows(w), counted)))


def _line_facts(line: Column) -> Column:
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    chars = F.length(F.translate(line, " \t\n\x0b\x0c\r", ""))
    return F.struct(line.alias("line"), symbols.alias("symbols"), chars.alias("chars"), F.size(words_of(line)).alias("words"))


def _line_fails(x: Column, rules: Rules) -> Column:
    line = x["line"]
    punctuation = (x["symbols"] > rules.max_symbol_share * x["chars"]) | ((x["words"] >= rules.prose_words) & ~line.rlike(r"[.!?;:,。！？…]"))
    separators = F.length(line) - F.length(F.translate(line, SEPARATORS, ""))
    navigation = (separators >= rules.min_separators) & (separators * rules.words_per_item >= x["words"])
    low = F.lower(line)
    boilerplate = (x["words"] <= rules.boilerplate_words) & F.exists(F.array(*map(F.lit, BOILERPLATE)), lambda p: F.contains(low, p))
    return punctuation | navigation | boilerplate


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), cleaned: bool = False) -> DataFrame:
    """One row per row of ``docs``: counts, verdict and, if ``cleaned``, the text without failed lines.

    id; n_words; word_chars (code points in words); n_symbols; n_dup_lines (lines with a word, equal to an earlier
    line); n_repeat_words; base_failed; kept; n_lines and n_failed_lines (lines with a word); lost_chars (word
    characters on failed lines). A null or empty text has no words and fails. Rows are judged alone: repeated rows
    and null ids stay, an empty table gives no rows, and other columns are not read, whatever their names.
    """
    text = no_null(text_col)
    # every line with its verdict, made once; a line without a word has no characters and fails no rule
    lines = F.transform(F.transform(F.split(text, "\n"), _line_facts), lambda x: F.struct(x["line"].alias("line"), x["chars"].alias("chars"), ((x["chars"] > 0) & _line_fails(x, rules)).alias("bad")))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), words_of(text).alias("words"), lines.alias("lines"))
    said = F.filter("lines", lambda x: x["chars"] > 0)
    judged = base.select(
        "id",
        "text",
        "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(F.transform(said, lambda x: x["line"]), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size(said).cast("long").alias("n_lines"),
        F.filter("lines", lambda x: x["bad"]).alias("failed"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    lost = F.aggregate("failed", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    out = judged.withColumns({"base_failed": failed, "lost_chars": lost, "n_failed_lines": F.size("failed").cast("long")})
    kept = ~F.col("base_failed") & (F.col("lost_chars") <= rules.max_lost_share * F.col("word_chars"))
    columns = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_lines", "n_failed_lines", "lost_chars"]
    if cleaned:
        rest = F.array_join(F.transform(F.filter("lines", lambda x: ~x["bad"]), lambda x: x["line"]), "\n")
        columns.append(F.when(F.col("n_failed_lines") > 0, rest).otherwise(F.col("text")).alias("text"))
    return out.select(*columns)
