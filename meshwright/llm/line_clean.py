"""Line-first cleaning, with DataFrame functions only.

Each line of a text is judged by itself (punctuation, navigation, boilerplate); failing lines
go, and a document that loses too much of its text goes as a whole. Documents that fail the
base counts (few words, many repeated windows of words) go as well.

Cases: null and empty texts have no words, so they fail; a line of white space neither counts
nor fails and stays; equal rows are judged alike, each for itself; texts of any length are
judged whole; other columns pass through untouched and are never read by name (working columns
begin with ``_lc_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED_PERCENT = 30
#: A document goes when more than this share of its non-blank characters stood in failed lines.
MAX_LOST_PERCENT = 50
#: Fixed values of the line rules, matched in lower-cased lines: words that open a menu line, and phrases, by language.
MENU_WORDS = {
    "en": ("home", "menu", "login", "log in", "sign in", "sign up", "register", "search", "next", "previous", "back to top", "skip to content", "read more", "share", "contact", "sitemap"),
    "de": ("startseite", "menü", "anmelden", "registrieren", "suche", "weiter", "zurück", "nach oben", "zum inhalt", "weiterlesen", "mehr lesen", "teilen", "kontakt", "impressum"),
    "es": ("inicio", "menú", "iniciar sesión", "registrarse", "buscar", "siguiente", "anterior", "volver arriba", "ir al contenido", "leer más", "compartir", "contacto"),
    "fr": ("accueil", "connexion", "se connecter", "s'inscrire", "rechercher", "suivant", "précédent", "haut de page", "aller au contenu", "lire la suite", "partager", "plan du site"),
}
PHRASES = {
    "en": ("enable javascript", "uses cookies", "use of cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "lorem ipsum", "subscribe to our", "click here"),
    "de": ("javascript aktivieren", "verwendet cookies", "cookie-richtlinie", "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "newsletter abonnieren", "hier klicken"),
    "es": ("activar javascript", "utiliza cookies", "política de cookies", "política de privacidad", "términos de uso", "todos los derechos reservados", "haga clic aquí", "haz clic aquí"),
    "fr": ("activer javascript", "utilise des cookies", "politique de cookies", "politique de confidentialité", "conditions d'utilisation", "tous droits réservés", "cliquez ici"),
}
LANGUAGES = tuple(MENU_WORDS)
#: Sentence marks of Latin, Chinese and Japanese, Arabic and Urdu, Indic and Ethiopic writing; what may stand at a line's end.
MARKS = ".!?…:;。！？：；．؟۔؛।॥።"
MARK = f"[{MARKS}]"
AT_END = MARKS + "\"'”’»)]」』》）】"
#: A run of letters of a script without blanks between words (Thai, Lao, kana, Han) is as good as four words.
FOUR_WORDS = r"^\s*\S+\s+\S+\s+\S+\s+\S|[\u0E00-\u0EFF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF]{8}"
BARS = r"\|[^|]*\|"
SYMBOL = r"[#*$%&|<>]"
LINK = r"(https?://|www\.)\S+"


def menu_pattern(languages: tuple[str, ...]) -> tuple[str, str]:
    """A line that opens with a menu word and has no sentence's end; and the opening alone, to be looked for first."""
    words = "|".join(w for k in languages for w in MENU_WORDS[k])
    return rf"^({words})([^\p{{L}}\p{{N}}_.!?。！？؟۔।][^.!?。！？؟۔।]*)?$", rf"^({words})([^\p{{L}}\p{{N}}_]|$)"


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, also where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACES}]+"), "")


def blank(line: Column) -> Column:
    return ~line.rlike(f"[^{SPACES}]")


def symbols_in(text: Column) -> Column:
    return F.when(text.rlike(SYMBOL), F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).otherwise(F.lit(0))


def chars_of(words: Column) -> Column:
    return F.length(F.array_join(words, ""))


def repeated_words(words: Column, n: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows found twice or more. Windows are compared by a 64-bit hash
    of their words inside one text; only texts with an equal pair are sorted."""

    def covered(hashes: Column) -> Column:
        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
            hit = F.filter(F.sequence(F.lit(0), last), lambda i: ((i > 0) & same(i, i - 1)) | ((i < last) & same(i, i + 1)))
            return F.sort_array(F.transform(hit, lambda i: F.get(s, i)["i"]))

        def total(p: Column) -> Column:
            gaps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

        return bound(bound(keyed, starts), total)

    def doubled(h: Column, size: int) -> Column:
        """From hashes of windows of ``size`` words those of twice as many; the ends are cut off last."""
        return h if size >= window else doubled(bound(h, lambda x: F.zip_with(x, F.slice(x, size + 1, n), lambda a, b: F.xxhash64(a, b))), 2 * size)

    if window & (window - 1):
        raise ValueError("window is a power of two")
    hashed = F.slice(doubled(F.transform(words, lambda x: F.xxhash64(x)), 1), 1, n - (window - 1))
    found = bound(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(n > window, found).otherwise(F.lit(0).cast("long"))


def line_fails(line: Column, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """Whether one line with at least one word fails a rule.

    Punctuation: no sentence mark anywhere, or fewer than four words and no mark at the end.
    Navigation: parts between bars, or a line that opens with a menu word and has no mark.
    Boilerplate: a fixed phrase, symbols that make up over a tenth of its characters, or links that
    make up over half of them.
    """
    menu, opening = menu_pattern(languages)

    def rules(trimmed: Column) -> Column:
        at_end = F.right(trimmed, F.lit(1)).isin(*AT_END)
        shape = ~trimmed.rlike(MARK) | (~at_end & ~trimmed.rlike(FOUR_WORDS)) | (F.contains(trimmed, F.lit("|")) & trimmed.rlike(BARS))
        heavy = symbols_in(trimmed) * 10 > F.length(trimmed)
        linked = F.when(F.contains(trimmed, F.lit("://")) | F.contains(trimmed, F.lit("www.")), F.length(F.regexp_replace(trimmed, LINK, "")) * 2 < F.length(trimmed)).otherwise(F.lit(False))
        return shape | heavy | linked | bound(F.lower(trimmed), lambda low: F.when(F.substr(low, F.lit(1), F.lit(20)).rlike(opening), low.rlike(menu)).otherwise(F.lit(False)) | phrase(low))

    def phrase(low: Column) -> Column:
        out = F.lit(False)
        for p in (p for k in languages for p in PHRASES[k]):
            out = out | F.contains(low, F.lit(p))
        return out

    return bound(F.when(F.right(line, F.lit(1)).isin(*SPACES), F.rtrim(line, F.lit(SPACES))).otherwise(line), rules)


def judged(docs: DataFrame, text: str = "text", languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """``docs`` with ``_lc_`` columns: the base counts, ``_lc_base_failed``, ``_lc_kept`` and the cleaned text.
    Menu words and phrases are those of the ``languages``, in every document."""
    whole = docs.withColumn("_lc_text", F.coalesce(F.col(text).cast("string"), F.lit("")))

    # Arrays stay inside one expression: between two operators they would be copied row by row.
    def of_words(w: Column) -> Column:
        n = F.size(w)
        return F.struct(n.cast("long").alias("n_words"), chars_of(w).cast("long").alias("word_chars"), repeated_words(w, n).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        full = bound(F.filter(lines, lambda x: ~blank(x)), lambda x: F.size(x) - F.size(F.array_distinct(x)))
        good = F.filter(lines, lambda x: blank(x) | ~line_fails(x, languages))
        return F.struct(full.cast("long").alias("n_dup_lines"), F.array_join(good, "\n").alias("cleaned"), F.size(good).alias("n_good"), F.size(lines).alias("n"))

    counted = whole.withColumns({"_lc_w": bound(words_of(F.col("_lc_text")), of_words), "_lc_l": bound(F.split(F.col("_lc_text"), "\n"), of_lines)})
    n, repeated = F.col("_lc_w.n_words"), F.col("_lc_w.n_repeat_words")
    left = F.when(F.col("_lc_l.n_good") == F.col("_lc_l.n"), F.col("_lc_w.word_chars")).otherwise(chars_of(words_of(F.col("_lc_l.cleaned"))).cast("long"))
    out = counted.withColumns(
        {
            "_lc_n_words": n, "_lc_word_chars": F.col("_lc_w.word_chars"), "_lc_n_repeat_words": repeated, "_lc_n_dup_lines": F.col("_lc_l.n_dup_lines"),
            "_lc_n_symbols": symbols_in(F.col("_lc_text")).cast("long"), "_lc_cleaned": F.col("_lc_l.cleaned"),
            "_lc_base_failed": (n < MIN_WORDS) | (repeated * 100 > n * MAX_REPEATED_PERCENT), "_lc_lost": F.col("_lc_w.word_chars") - left,
        }
    ).withColumn("_lc_kept", ~F.col("_lc_base_failed") & ~(F.col("_lc_lost") * 100 > F.col("_lc_word_chars") * MAX_LOST_PERCENT))
    return out.drop("_lc_text", "_lc_w", "_lc_l")


def quality(docs: DataFrame) -> DataFrame:
    """The judgement of every document: counts, verdicts, and how many characters its failed lines held."""
    out = judged(docs)
    return out.select(
        "doc_id", *(F.col(f"_lc_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")),
        F.col("_lc_lost").alias("n_lost_chars"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with their failed lines removed, in the columns of ``docs``; ``n_chars``, if there is one, follows the text."""
    kept = judged(docs).where("_lc_kept")
    new = {"text": F.col("_lc_cleaned")} | ({"n_chars": F.length("_lc_cleaned").cast("long")} if "n_chars" in docs.columns else {})
    return kept.withColumns(new).select(*docs.columns)
