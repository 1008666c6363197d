"""License scan by ordered signature rules, in DataFrame operations only.

Rules are regular expressions over a text's words joined by blanks; versions, suffixes and variants multiply a few
signatures into hundreds of rules, and a rule's priority is its place. Texts without a keyword, which are nearly all, are
passed over by substring search. In the others, a rule runs only if its own keyword is there. Detections are intervals of
words. They are taken by start, longest first, and by priority; one that lies inside what was taken is suppressed. A rule
for licenses without a signature runs only where nothing else was found.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words, before A-Z is lower-cased.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str


def _versions(*versions: str) -> list[tuple[str, str]]:
    """(2.0, pattern of ``2 0`` or ``v2 0``); a trailing zero may be left out."""
    return [(v, "(?:version |v )?v?" + (f"{v[:-2]}(?: 0)?(?! \\d)" if v.endswith(".0") else v.replace(".", " "))) for v in versions]


def rules() -> list[Rule]:
    """All rules in order of priority: the more specific first."""
    out: list[Rule] = []
    names = "apache-2.0 mit bsd-2-clause bsd-3-clause mpl-2.0 isc gpl-2.0-only gpl-3.0-only lgpl-2.1-only lgpl-3.0-only agpl-3.0-only epl-2.0 cc0-1.0 cc-by-4.0 cc-by-sa-4.0 unlicense zlib bsl-1.0"
    for name in names.split():
        out.append(Rule(name, "spdx", "spdx license identifier " + name.replace("-", " ").replace(".", " ")))

    kinds = {"by-nc-sa": ("noncommercial", "sharealike"), "by-nc-nd": ("noncommercial", "noderiv(?:ative)?s"), "by-nc": ("noncommercial",), "by-sa": ("sharealike",), "by-nd": ("noderiv(?:ative)?s",), "by": ()}
    worded = {"noncommercial": "non ?commercial", "sharealike": "share ?alike", "noderiv(?:ative)?s": "no ?deriv(?:ative)?s"}
    for (kind, parts), (v, number) in product(kinds.items(), _versions("4.0", "3.0", "2.5", "2.0", "1.0")):
        out.append(Rule(f"cc-{kind}-{v}", "cc ", f"cc {kind.replace('-', ' ')} {number}"))
        out.append(Rule(f"cc-{kind}-{v}", "creative commons", "creative commons attribution " + "".join(worded[p] + " " for p in parts) + number))
    for kind, parts in kinds.items():
        out.append(Rule(f"cc-{kind}", "cc ", f"cc {kind.replace('-', ' ')}"))
        out.append(Rule(f"cc-{kind}", "creative commons", "creative commons attribution" + "".join(" " + worded[p] for p in parts)))
        out.append(Rule(f"cc-{kind}", "creativecommons", f"creativecommons org licenses {kind.replace('-', ' ')}"))

    families = {"agpl": ("affero ", ("3.0", "1.0")), "lgpl": ("(?:lesser|library) ", ("3.0", "2.1", "2.0")), "gpl": ("", ("3.0", "2.0", "1.0"))}
    suffixes = {"-or-later": " (?:or (?:\\(?at your option\\)? )?(?:any )?later(?: version)?|or newer)", "-only": " only", "": ""}
    for (family, (word, versions)), (suffix, tail) in product(families.items(), suffixes.items()):
        for v, number in _versions(*versions):
            out.append(Rule(f"{family}-{v}{suffix}", "public license", f"(?:gnu )?{word}general public license {number}{tail}"))
            out.append(Rule(f"{family}-{v}{suffix}", family, f"(?:gnu )?{family} ?{number}{tail}"))
    for family, (word, _) in families.items():
        out.append(Rule(family, "public license", f"(?:gnu )?{word}general public license"))
        out.append(Rule(family, family, f"gnu {family}|{family}(?: licen[sc]ed?)"))

    versioned = {
        "apache": ("apache", "apache (?:software )?licen[sc]e", ("2.0", "1.1", "1.0")),
        "mpl": ("mozilla", "mozilla public license", ("2.0", "1.1", "1.0")),
        "epl": ("eclipse", "eclipse public license", ("2.0", "1.0")),
        "cddl": ("common development", "common development and distribution license", ("1.1", "1.0")),
        "eupl": ("european union", "european union public licen[sc]e", ("1.2", "1.1", "1.0")),
        "artistic": ("artistic", "artistic licen[sc]e", ("2.0", "1.0")),
        "osl": ("open software", "open software licen[sc]e", ("3.0", "2.1", "2.0", "1.1", "1.0")),
        "afl": ("academic free", "academic free licen[sc]e", ("3.0", "2.1", "2.0", "1.2", "1.1")),
        "ofl": ("open font", "(?:sil )?open font licen[sc]e", ("1.1", "1.0")),
        "bsl": ("boost", "boost software licen[sc]e", ("1.0",)),
        "lppl": ("latex", "latex project public licen[sc]e", ("1.3", "1.2", "1.1", "1.0")),
        "psf": ("python", "python (?:software foundation )?licen[sc]e", ("2.0",)),
        "php": ("php", "php licen[sc]e", ("3.01", "3.0")),
        "zpl": ("zope", "zope public licen[sc]e", ("2.1", "2.0", "1.1")),
        "ms-pl": ("microsoft", "microsoft public licen[sc]e", ("1.0",)),
        "cpl": ("common public", "common public licen[sc]e", ("1.0",)),
        "upl": ("universal permissive", "universal permissive licen[sc]e", ("1.0",)),
        "odc-by": ("open data commons", "open data commons attribution licen[sc]e", ("1.0",)),
        "odbl": ("open database", "open database licen[sc]e", ("1.0",)),
        "cc0": ("cc0", "cc0", ("1.0",)),
    }
    for name, (keyword, phrase, versions) in versioned.items():
        for v, number in _versions(*versions):
            out.append(Rule(f"{name}-{v}", keyword, f"{phrase} {number}"))
        out.append(Rule(name, keyword, phrase))
    for n, word in (("4", "four"), ("3", "three"), ("2", "two"), ("0", "zero")):
        out.append(Rule(f"bsd-{n}-clause", "bsd", f"(?:bsd (?:{n}|{word}) clause(?: licen[sc]e)?|(?:{n}|{word}) clause bsd(?: licen[sc]e)?)"))
    for label, keyword, phrase in (
        ("bsd", "bsd", "bsd(?: style)? licen[sc]ed?"),
        ("mit", "mit ", "(?:the )?mit licen[sc]e|licen[sc]ed under (?:the )?mit"),
        ("mit", "x11 ", "x11 licen[sc]e"),
        ("mit", "expat ", "expat licen[sc]e"),
        ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
        ("isc", "isc ", "isc licen[sc]e"),
        ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose"),
        ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e"),
        ("unlicense", "unlicense", "(?:the )?unlicense"),
        ("wtfpl", "wtfpl", "wtfpl"),
        ("cc0", "cc0", "cc0"),
        ("public-domain", "public domain", "(?:released into|dedicated to|in) the public domain"),
        ("proprietary", "proprietary", "proprietary and confidential"),
        ("reserved", "rights reserved", "(?:all|some|no) rights reserved"),
        ("copyright", "copyright", "copyright (?:c )?(?:19|20)\\d\\d"),
    ):
        out.append(Rule(label, keyword, phrase))
    return out


#: Run only where no other rule detects anything.
FALLBACK = (Rule("licensed", "licen", "(?:released|distributed|licen[sc]ed|available) under (?:the )?(?:terms of )?(?:the )?\\S+(?: \\S+){0,3}? licen[sc]e"),)
#: Every detection but those of ``cc by`` has one of these in it, whatever separates its words.
GATE = ("licen", "copyright", "reserved", "commons", "gpl", "spdx", "bsd", "cc0", "permission", "domain", "proprietary", "wtfpl")


#: Stands before a match; no word has it.
MARK = "\x01"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _places(line: Column, pattern: Column, label: Column, rank: Column) -> Column:
    """(start, -end, rank, end, label) in words of all matches of a pattern in `` word word ``."""
    bounded = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    kind = "array<struct<start:int,back:int,rank:int,end:int,label:string>>"
    # a match is marked before its first word, so the marked words are the starts
    marked = F.split(F.regexp_replace(line, bounded, F.lit(MARK + "$0")), " ", -1)
    starts = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(MARK)), i - 1)), lambda i: i.isNotNull())

    def interval(first: Column, match: Column) -> Column:
        end = first + _blanks(match) + 1
        return F.struct(first.cast("int").alias("start"), (-end).cast("int").alias("back"), rank.alias("rank"), end.cast("int").alias("end"), label.alias("label"))

    found = F.zip_with(starts, F.regexp_extract_all(line, bounded, F.lit(0)), interval)
    return F.when(F.regexp_like(line, bounded), found).otherwise(F.array().cast(kind)).cast(kind)


def _resolved(all_found: Column) -> Column:
    """Labels and covered words of the detections that do not lie inside one taken before."""
    start = F.struct(F.lit(0).alias("far"), F.lit(0).alias("covered"), F.array().cast("array<string>").alias("labels"))

    def step(acc: Column, x: Column) -> Column:
        inside = x["end"] <= acc["far"]
        return F.struct(
            F.greatest(acc["far"], x["end"]).alias("far"),
            F.when(inside, acc["covered"]).otherwise(acc["covered"] + x["end"] - F.greatest(acc["far"], x["start"])).alias("covered"),
            F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(x["label"]))).alias("labels"),
        )

    return F.aggregate(F.sort_array(all_found), start, step)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    ``score`` is the share of words that detections cover. A null or empty text has no words, no labels and score 0; a null
    doc_id stays null; repeated rows are scanned each; an empty table gives no rows; other columns are ignored.
    """
    table = rules()
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_count(text, F.lit(WORD_PATTERN))
    gap, solid = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
    short = F.lit(f"(?<!{solid})cc{gap}+by(?!{solid})")
    passes = lambda low: F.exists(F.array(*map(F.lit, GATE)), lambda k: F.contains(low, k)) | (F.contains(low, F.lit("cc")) & F.regexp_like(low, short))
    gate = _let(F.lower(text), passes)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    line = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.translate(text, upper, lower), F.lit(solid + "+"), F.lit(0)), " "), F.lit(" "))

    def constant(those, first: int) -> Column:
        return F.array(*[F.struct(F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.label).alias("label"), F.lit(first + k).alias("rank")) for k, r in enumerate(those)])

    made, base, fallback = constant(table, 0), constant([Rule(b, p, p) for p, b in BASE.items()], len(table)), constant(FALLBACK, len(table) + len(BASE))

    def run(s: Column, those: Column) -> Column:
        active = F.filter(those, lambda r: F.contains(s, r["keyword"]))
        return F.flatten(F.transform(active, lambda r: _places(s, r["pattern"], r["label"], r["rank"])))

    kind = "struct<b:array<struct<start:int,back:int,rank:int,end:int,label:string>>,r:struct<far:int,covered:int,labels:array<string>>>"
    known = lambda s, r: F.when(F.size(r["labels"]) > 0, r).otherwise(_resolved(run(s, fallback)))
    both = lambda s: _let(run(s, base), lambda b: F.struct(b.alias("b"), _let(_resolved(F.concat(run(s, made), b)), lambda r: known(s, r)).alias("r")))
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), words.cast("bigint").alias("n_words"), F.when(gate, _let(line, both)).cast(kind).alias("found"))
    found = found.select("doc_id", "n_words", F.coalesce("found.b", F.array().cast("array<struct<start:int,back:int,rank:int,end:int,label:string>>")).alias("b"), F.coalesce("found.r.labels", F.array().cast("array<string>")).alias("more"), F.coalesce("found.r.covered", F.lit(0)).alias("covered"))
    starts, base_labels = F.transform("b", lambda x: x["start"]), F.array_distinct(F.transform("b", lambda x: x["label"]))
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    return found.select(
        "doc_id", "n_words", F.size("b").cast("bigint").alias("n_base"), F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(F.array_union(base_labels, F.col("more"))).alias("labels"), F.when(F.col("n_words") > 0, F.col("covered") / F.col("n_words")).otherwise(F.lit(0.0)).alias("score"),
    )
