"""License scan by ordered signature rules.

Native. Texts become lower-case words joined by single spaces. A gate looks for any keyword; behind it a rule runs only
where its own keyword occurs. Rules are regular expressions with a priority. Of overlapping detections the one that contains
the other stays; of those that overlap in part, the one of the better rule.
"""

from __future__ import annotations

from itertools import product
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslake.functions.base import let
from newslake.llm.common import text_of

#: Characters that separate words; everything else, letters of any script included, belongs to a word.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrase and label of the base detections.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

VERSION = r"(?: version)? v?"
GRANTS = r"(?:released|licensed|distributed|available|provided|published|covered|made available) under (?:the )?(?:terms of )?(?:the )?"


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, pattern) in order; a smaller priority is better. Patterns match normalised words.

    Every match of a pattern contains its keyword; forms without a common keyword are rules of their own.

    Hand-written forms of each family are combined with its versions and grants.
    """
    out: list[tuple[str, str, str]] = []
    gnu = (("gpl", "general public license", r"(?:gnu )?general public license", "gpl"),
           ("lgpl", "lesser general", r"(?:gnu )?lesser general public license", "lgpl"),
           ("lgpl", "library general", r"(?:gnu )?library general public license", None),
           ("agpl", "affero", r"(?:gnu )?affero general public license", "agpl"))
    tails = (("-or-later", r"(?: or| and)(?: at your option)?(?: any)? later(?: version)?"), ("-only", r" only"), ("", ""))
    for (label, keyword, long, short), version, (suffix, tail) in product(gnu, ("1", "2", "2 1", "3"), tails):
        name = f"{label}-{version.replace(' ', '.')}{suffix}"
        out.append((name, keyword, long + VERSION + version + r"(?: 0)?" + tail))
        if short:
            out.append((name, short, short + "(?: version)? ?v?" + version + r"(?: 0)?" + tail))
    for parts, version in product(("by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by"), ("1 0", "2 0", "2 5", "3 0", "4 0", "")):
        name = f"cc-{parts.replace(' ', '-')}" + (f"-{version.replace(' ', '.')}" if version else "")
        long = " ".join({"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}[p]
                        for p in parts.split())
        tail = f"(?: license)?{VERSION}{version}" if version else ""
        out.append((name, "cc by", f"cc {parts}{tail}"))
        out.append((name, "creative commons", f"creative commons {long}{tail}"))
        out.append((name, "creativecommons", f"creativecommons org licenses {parts}{' ' + version if version else ''}"))
    versioned = (
        ("apache", "apache", r"apache (?:software )?license", ("1 0", "1 1", "2 0")),
        ("mpl", "mozilla", r"mozilla public license", ("1 0", "1 1", "2 0")),
        ("epl", "eclipse", r"eclipse public license", ("1 0", "2 0")),
        ("cddl", "common development", r"common development and distribution license", ("1 0", "1 1")),
        ("artistic", "artistic", r"artistic license", ("1 0", "2 0")),
        ("afl", "academic free", r"academic free license", ("1 1", "1 2", "2 0", "2 1", "3 0")),
        ("osl", "open software", r"open software license", ("1 0", "2 0", "2 1", "3 0")),
        ("eupl", "european union", r"european union public licen[cs]e", ("1 0", "1 1", "1 2")),
        ("bsl", "boost", r"boost software license", ("1 0",)),
        ("ofl", "open font", r"(?:sil )?open font license", ("1 0", "1 1")),
        ("odbl", "database license", r"open (?:data commons )?database license", ("1 0",)),
        ("gfdl", "documentation license", r"(?:gnu )?free documentation license", ("1 1", "1 2", "1 3")),
        ("zpl", "zope", r"zope public license", ("1 1", "2 0", "2 1")),
        ("psf", "python", r"python (?:software foundation )?license", ("2",)),
    )
    for label, keyword, form, versions in versioned:
        for version in (*versions, ""):
            name = label + (f"-{version.replace(' ', '.')}" if version else "")
            tail = f"{VERSION}{version}" if version else ""
            out += [(name, keyword, GRANTS + form + tail), (name, keyword, form + tail)]
    plain = (
        ("mit", "mit license", r"mit license"),
        ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
        ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd) license"),
        ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd) license"),
        ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd) license"),
        ("bsd", "bsd", r"bsd(?: style)? license"),
        ("bsd", "redistribution and use", r"redistribution and use in source and binary forms"),
        ("isc", "isc license", r"isc license"),
        ("zlib", "zlib", r"zlib(?: libpng)? license"),
        ("unlicense", "unlicense", r"(?:the )?unlicense"),
        ("unlicense", "public domain", r"free and unencumbered software released into the public domain"),
        ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
        ("public-domain", "public domain", r"(?:released|dedicated|placed|is) (?:in|in the|into the|to the) public domain"),
        ("wtfpl", "public license", r"do what the fuck you want to public license"),
        ("ms-pl", "microsoft", r"microsoft public license"),
        ("ms-rl", "microsoft", r"microsoft reciprocal license"),
        ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source license"),
        ("openssl", "openssl", r"openssl license"),
        ("php", "php license", r"php license(?: version)? 3 0?1?"),
        ("beerware", "beer", r"beer ?ware license"),
        ("proprietary", "proprietary", r"proprietary and confidential|proprietary license"),
        ("proprietary", "may be reproduced", r"no part of this [a-z]+ may be reproduced"),
        ("proprietary", "reproduction", r"reproduction(?: in whole or in part)? (?:is )?prohibited"),
        ("reserved", "rights reserved", r"(?:all|some) rights reserved"),
        ("reserved", "tous droits", r"tous droits réservés"),
        ("reserved", "alle rechte", r"alle rechte vorbehalten"),
        ("reserved", "todos los derechos", r"todos los derechos reservados"),
        ("copyright", "copyright", r"copyright(?: c)? (?:19|20)[0-9]{2}"),
        ("spdx", "spdx", r"spdx license identifier [a-z0-9]+(?: [0-9]+){0,2}(?: or later| only)?"),
        ("gpl", "general public license", r"(?:gnu )?general public license"),
        ("lgpl", "lesser general", r"(?:gnu )?lesser general public license"),
        ("lgpl", "library general", r"(?:gnu )?library general public license"),
        ("agpl", "affero", r"(?:gnu )?affero general public license"),
    )
    mit = [("mit", "mit license", GRANTS + "mit license"), ("bsd", "bsd", GRANTS + "bsd license"), ("isc", "isc license", GRANTS + "isc license")]
    out += mit + list(plain)
    return [(i, label, keyword, f"(?<![^ ])(?:{pattern})(?![^ ])") for i, (label, keyword, pattern) in enumerate(out)]


def normalise(text: Column) -> Column:
    """Lower-case words joined by single spaces."""
    return F.btrim(F.regexp_replace(F.translate(text, ascii_uppercase, ascii_lowercase), GAP, " "), F.lit(" "))


def _places(norm: Column, pattern: Column, then) -> Column:
    """Array of ``then(start, end)`` for each match, in characters from 0, found from the pieces between the matches."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("got"))
    pieces = F.call_function("split", norm, pattern, F.lit(-1))
    matches = F.regexp_extract_all(norm, pattern, F.lit(0))
    found = F.aggregate(
        F.arrays_zip(F.transform(pieces, F.length).alias("p"), F.transform(matches, F.length).alias("m")), zero,
        lambda acc, x: F.struct(
            (acc["at"] + x["p"] + F.coalesce(x["m"], F.lit(0))).alias("at"),
            F.when(x["m"].isNull(), acc["got"]).otherwise(F.concat(acc["got"], F.array(F.struct(
                (acc["at"] + x["p"]).alias("s"), (acc["at"] + x["p"] + x["m"]).alias("e"))))).alias("got")))
    return F.transform(found["got"], lambda g: then(g["s"], g["e"]))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, the base measures, labels, score and ``n_detections``.

    A null or empty text has no words and score 0. Every row counts by itself, repeated ids included; equal detections of
    two rules keep the one of better priority; other columns are not read; an empty table gives an empty one. The score
    is 1 - 1 / (1 + number of labels).
    """
    table = rules()
    keywords = sorted({r[2] for r in table})
    minimal = [k for k in keywords if not any(o != k and o in k for o in keywords)]
    raw = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), text_of().alias("text"))
    gate = F.lit(False)
    norm = raw.withColumn("n_words", F.regexp_count("text", F.lit(RAW_WORD)).cast("bigint")).withColumn("norm", normalise(F.col("text")))
    for word in minimal:
        gate = gate | F.contains("norm", F.lit(word))
    base = F.array(*[F.struct(F.lit(f"(?<![^ ]){p}(?![^ ])").alias("pattern"), F.lit(b).alias("label")) for p, b in BASE.items()])
    signatures = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(label).alias("label"), F.lit(k).alias("keyword"), F.lit(x).alias("pattern"))
                           for p, label, k, x in table])
    before = lambda s: F.length(F.substring("norm", F.lit(1), s)) - F.length(F.replace(F.substring("norm", F.lit(1), s), F.lit(" "), F.lit("")))
    found = F.flatten(F.transform(base, lambda b: _places(F.col("norm"), b["pattern"], lambda s, e: F.struct(
        s.alias("s"), b["label"].alias("label")))))
    hits = F.flatten(F.transform(
        F.filter(signatures, lambda r: F.contains("norm", r["keyword"])),
        lambda r: _places(F.col("norm"), r["pattern"], lambda s, e: F.struct(
            s.alias("s"), e.alias("e"), r["priority"].alias("priority"), r["label"].alias("label")))))
    rows = norm.withColumn("base", F.when(gate, let(found, lambda b: F.struct(
        F.size(b).cast("bigint").alias("n"), F.array_sort(F.array_distinct(b["label"])).alias("labels"),
        before(F.array_min(b["s"])).cast("bigint").alias("first"), before(F.array_max(b["s"])).cast("bigint").alias("last")))))
    rows = rows.withColumn("hits", F.when(gate, hits)).select("doc_id", "rid", "n_words", "base", F.explode_outer("hits").alias("h"))
    return _resolve(rows)


def _resolve(rows: DataFrame) -> DataFrame:
    by = Window.partitionBy("rid").orderBy(F.col("h.s"), F.col("h.e").desc(), F.col("h.priority"))
    reach = F.max("h.e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    outer = rows.withColumn("reach", reach).where(F.col("h").isNull() | F.col("reach").isNull() | (F.col("h.e") > F.col("reach")))
    after = Window.partitionBy("rid").orderBy(F.col("h.s"))
    beside = outer.withColumns({"p": F.lag("h").over(after), "q": F.lead("h").over(after)})
    beaten = ((F.col("p.e") > F.col("h.s")) & (F.col("p.priority") < F.col("h.priority"))) | (
        (F.col("q.s") < F.col("h.e")) & (F.col("q.priority") < F.col("h.priority")))
    kept = beside.withColumn("label", F.when(~F.coalesce(beaten, F.lit(False)), F.col("h.label")))
    one = kept.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("base").alias("base"),
        F.collect_set("label").alias("own"), F.count("label").alias("n_detections"))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union(F.coalesce("base.labels", none), "own"))
    return one.select(
        "doc_id", "n_words", F.coalesce("base.n", F.lit(0)).alias("n_base"),
        F.col("base.first").alias("first_word"), F.col("base.last").alias("last_word"),
        F.array_join(F.coalesce("base.labels", none), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        (1 - 1 / (1 + F.size(labels))).alias("score"), "n_detections")
