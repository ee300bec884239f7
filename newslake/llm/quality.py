"""Line-first cleaning: judge every line, drop those that fail, then reject documents that lose too much text.

Native: every step is a built-in expression over one row, so a scan is the only stage and no text is shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.functions.base import let
from newslake.llm.common import SPACE, SPACE_CHARS, WORD, fresh, same_columns, text_of, wordlist

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SYMBOL = f"[{SYMBOLS}]"
#: A line fails if over one character in this many is a symbol.
SYMBOL_SHARE = 10
#: Lines of fewer words need a final punctuation mark.
SHORT_LINE = 4
#: A document is rejected if less than this percentage of its characters is left.
MIN_KEPT_PERCENT = 50

#: Patterns of lines to drop; they mean the same in Java's and in RE2's syntax.
LINE_PATTERNS = {
    "shouted": r"!![^\n]*!![^\n]*!!",
    "menu_bar": r"(\|[^|]*){3}|([»›•·][^»›•·]*){3}",
    "menu_entry": r"(?i)^\s*(home|menu|contact( us)?|about( us)?|log ?in|log ?out|sign ?(in|up)|register|search|sitemap|"
                  r"next|previous|back to top|skip to (main )?content|share|print|reply|"
                  r"impressum|startseite|kontakt|[üÜ]ber uns|suche|anmelden|abmelden|weiter|zur[üÜ]ck|nach oben|"
                  r"accueil|rechercher|connexion|d[éÉ]connexion|suivant|pr[éÉ]c[éÉ]dent|[àÀ] propos|haut de page|"
                  r"inicio|contacto|buscar|iniciar sesi[óÓ]n|siguiente|anterior|acerca de|volver arriba)\s*$",
    "boilerplate": r"(?i)(accept|use)s? (all )?cookies|cookie (policy|settings)|privacy policy|terms (of|and) (use|service|conditions)|"
                   r"(enable|requires?) javascript|subscribe to (our|the)|sign up for (our|the)|click here|read more\b|"
                   r"follow us on|share (this|on)|powered by wordpress|lorem ipsum|skip to (main )?content|"
                   r"all rights reserved\.?\s*$|"
                   r"cookies akzeptieren|datenschutzerkl[äÄ]rung|nutzungsbedingungen|newsletter abonnieren|hier klicken|weiterlesen\b|"
                   r"folgen sie uns|alle rechte vorbehalten|"
                   r"accepter (tous )?les cookies|politique de confidentialit[éÉ]|conditions d.utilisation|mentions l[éÉ]gales|"
                   r"abonnez-vous|cliquez ici|lire la suite|suivez-nous|tous droits r[éÉ]serv[éÉ]s|"
                   r"aceptar (todas )?las cookies|pol[íÍ]tica de privacidad|t[éÉ]rminos (de uso|y condiciones)|aviso legal|"
                   r"suscr[íÍ]bete|haga clic aqu[íÍ]|leer m[áÁ]s|s[íÍ]guenos|todos los derechos reservados",
}
#: A menu has so many separators and at most so many words to each of its entries on average.
MENU_MARKS = 3
ENTRY_WORDS = 4
#: Boilerplate phrases make up one in so many words of a line, or more.
PHRASE_SHARE = 3
#: Separators of menu entries, and quotation marks that open or close: those in pairs separate nothing. A dot between letters belongs to a word.
SEPARATOR = r"[|•]|·(?!\p{L})|(?<!\p{L})·"
QUOTES = (("»", "«"), ("›", "‹"))
ENTRY_WORD = r"[^\x20\x09-\x0D|»›•«‹]+"
#: The end of a finished sentence, closing marks included.
FINISHED = r"[.!?…:;。！？][\"'”’»)\]]*\s*$"


#: A pattern can match a line only if the lower-cased text holds one of these; the tests keep patterns off most texts.
GATES = {
    "shouted": ("!!",),
    "menu_bar": ("|", "»", "›", "•", "·"),
    "boilerplate": ("cookie", "privacy", "terms", "javascript", "subscribe", "sign up", "click here", "read more", "follow us",
                    "share", "wordpress", "lorem", "skip to", "rights reserved",
                    "datenschutzerkl", "nutzungsbedingungen", "newsletter abonnieren", "hier klicken", "weiterlesen", "folgen sie uns",
                    "rechte vorbehalten", "confidentialit", "conditions d", "mentions l", "abonnez-vous", "cliquez ici", "lire la suite",
                    "suivez-nous", "tous droits r", "de privacidad", "rminos ", "aviso legal", "suscr", "haga clic", "leer m", "guenos",
                    "los derechos reservados"),
}
#: So many words make a line long enough to end without a mark.
LONG_LINE = SPACE.replace("+", "*") + "(?:" + WORD + SPACE + ")" + "{%d}" % (SHORT_LINE - 1) + WORD


def _count(line: Column, pattern: str) -> Column:
    return F.regexp_count(line, F.lit(pattern))


def _large_share(line: Column) -> dict[str, Column]:
    """Whether the marks or phrases of a rule make up a large share of a line that its pattern fits."""
    marks = _count(line, SEPARATOR)
    for one, other in QUOTES:
        marks = marks + F.greatest(F.lit(0), _count(line, one) - _count(line, other))
    phrases = F.array_join(F.regexp_extract_all(line, F.lit(f"({LINE_PATTERNS['boilerplate']})"), F.lit(0)), " ")
    return {
        "menu_bar": (marks >= MENU_MARKS) & (_count(line, ENTRY_WORD) <= (marks + 1) * ENTRY_WORDS),
        "boilerplate": _count(phrases, WORD) * PHRASE_SHARE >= _count(line, WORD),
    }


def line_fails(line: Column, gates: dict[str, Column], symbols: Column) -> Column:
    """True if a line is not running text: shouted, mostly a menu or boilerplate, symbols, or a short scrap without an end."""
    failed = F.lit(False)
    shares = _large_share(line)
    for name, pattern in LINE_PATTERNS.items():
        fits = gates[name] & line.rlike(pattern) if name in gates else line.rlike(pattern)
        failed = failed | (fits & shares[name] if name in shares else fits)
    scrap = ~line.rlike("^" + LONG_LINE) & ~line.rlike(FINISHED) & line.rlike(WORD)
    return failed | (symbols > 0) & (F.regexp_count(line, F.lit(SYMBOL)) * SYMBOL_SHARE > F.length(line)) | scrap


def clean_lines(text: Column, symbols: Column) -> Column:
    """The text without the lines that fail; lines without a word stay. ``symbols`` is the text's number of symbols."""
    def gates(lowered: Column) -> Column:
        held = {n: reduce(or_, [F.contains(lowered, F.lit(w)) for w in words]) for n, words in GATES.items()}
        return F.struct(symbols.alias("symbols"), *[c.alias(n) for n, c in held.items()])

    return let(let(F.lower(text), gates), lambda g: F.array_join(F.filter(
        F.split(text, "\n"), lambda line: ~line_fails(line, {n: g[n] for n in GATES}, g["symbols"])), "\n"))


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more.

    Each window becomes its 64-bit hash and its place. One sort brings equal windows together, so the cost is n log n for
    any text. Windows count as equal if their whole hashes are, so false repeats are expected in n * n / 2 ** 65 windows: 3e-6
    in a text of 10 million words.
    """
    def windows(w: Column) -> Column:
        return let(
            F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
                F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))),
            lambda s: covered(places(s)))

    def places(s: Column) -> Column:
        held = F.filter(F.sequence(F.lit(0), F.size(s) - 2), lambda j: F.get(s, j)["h"] == F.get(s, j + 1)["h"])
        place = lambda j: F.get(s, j)["i"]
        return F.sort_array(F.array_distinct(F.concat(F.transform(held, place), F.transform(held, lambda j: place(j + 1)))))

    def covered(found: Column) -> Column:
        return let(found, lambda p: F.aggregate(
            F.when(F.size(p) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(p) - 1)),
            F.lit(0).cast("bigint"),
            lambda total, j: total + F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(3))).cast("bigint")))

    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(windows(words))


def word_chars(text: Column) -> Column:
    """Code points outside white space."""
    return (F.length(text) - F.regexp_count(text, F.lit(SPACE.rstrip("+")))).cast("bigint")


def judge(docs: DataFrame, text: str = "text", q: str = "q_") -> DataFrame:
    """The documents with their measures, ``clean_text`` and the verdict ``kept``, in columns whose names begin with ``q``.

    A null text counts as empty and is rejected; every row is judged by itself, so repeated rows, ties and null ids
    need no rule; an empty table gives an empty one; columns of the input stay, except that equal names are replaced.
    """
    t = text_of(text)
    measured = docs.withColumn(f"{q}counts", let(wordlist(t), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words"))))
    lines = F.split(t, "\n")
    worded = F.filter(lines, lambda line: F.length(F.btrim(line, F.lit(SPACE_CHARS))) > 0)
    measured = measured.withColumns({
        f"{q}n_words": F.col(f"{q}counts.n_words"),
        f"{q}word_chars": word_chars(t),
        f"{q}n_symbols": F.regexp_count(t, F.lit(SYMBOL)).cast("bigint"),
        f"{q}n_dup_lines": let(worded, lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("bigint"),
        f"{q}n_repeat_words": F.col(f"{q}counts.n_repeat_words"),
    }).drop(f"{q}counts").withColumn(f"{q}clean_text", clean_lines(t, F.col(f"{q}n_symbols")))
    n_words = F.col(f"{q}n_words")
    failed = (n_words < MIN_WORDS) | (F.col(f"{q}n_repeat_words") * 100 > n_words * MAX_REPEAT_PERCENT)
    left = word_chars(F.col(f"{q}clean_text")) * 100 >= F.col(f"{q}word_chars") * MIN_KEPT_PERCENT
    return measured.withColumn(f"{q}base_failed", failed).withColumn(f"{q}kept", ~F.col(f"{q}base_failed") & left)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its measures and verdict, and the characters that the line rules leave."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(docs.select("doc_id", "text")).select(
        "doc_id", *[F.col(f"q_{n}").alias(n) for n in names], F.length("q_clean_text").cast("bigint").alias("clean_chars"))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their cleaned text.

    Rows are judged one by one, as ``judge`` says: null and empty texts go, repeated rows stay or go together. Other columns
    come through as they are, whatever their names; an empty table gives an empty one.
    """
    own = fresh(docs)
    passed = judge(docs, q=own).where(F.col(f"{own}kept"))
    return passed.withColumn("text", F.col(f"{own}clean_text")).select(*same_columns(docs))


def sql() -> str:
    """The report in DuckDB's SQL. Dots between letters are taken out first, as RE2 cannot look around."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    count = lambda s, p: f"len(regexp_extract_all({s}, {q(p)}))"
    inner = q(r"(\p{L})·(\p{L})")
    dots = f"regexp_replace(regexp_replace(l, {inner}, '\\1\\2', 'g'), {inner}, '\\1\\2', 'g')"
    marks = "(" + " + ".join([count(dots, "[|•·]")] + [f"greatest(0, {count('l', a)} - {count('l', b)})" for a, b in QUOTES]) + ")"
    phrases = f"array_to_string(regexp_extract_all(l, {q(LINE_PATTERNS['boilerplate'])}), ' ')"
    share = {"menu_bar": f" AND {marks} >= {MENU_MARKS} AND {count('l', ENTRY_WORD)} <= ({marks} + 1) * {ENTRY_WORDS}",
             "boilerplate": f" AND {count(phrases, WORD)} * {PHRASE_SHARE} >= {count('l', WORD)}"}
    bad = " OR ".join(f"(regexp_matches(l, {q(p)}){share.get(n, '')})" for n, p in LINE_PATTERNS.items())
    bare = lambda s: f"translate({s}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM t),
win AS (SELECT rid, i, list_value(w[i], w[i + 1], w[i + 2]) AS g
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 3)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice WHERE n > 1) GROUP BY rid),
li AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda l: NOT ({bad}
         OR (length(l) - length(translate(l, '{SYMBOLS}', ''))) * {SYMBOL_SHARE} > length(l)
         OR (length({bare('l')}) > 0 AND len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) < {SHORT_LINE}
             AND NOT regexp_matches(l, {q(FINISHED)})))) AS ok,
       list_filter(string_split(text, chr(10)), lambda l: length({bare('l')}) > 0) AS worded FROM t),
m AS (SELECT doc_id, len(w) AS n_words, length({bare('text')}) AS word_chars,
        length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
        len(worded) - len(list_distinct(worded)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
        coalesce(array_to_string(ok, chr(10)), '') AS clean_text
      FROM t JOIN w USING (rid) JOIN li USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  n_repeat_words, base_failed, NOT base_failed AND length({bare('clean_text')}) * 100 >= word_chars * {MIN_KEPT_PERCENT} AS kept,
  length(clean_text) AS clean_chars
FROM (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM m)
"""
