"""License scan: ordered signature rules behind a keyword prefilter.

A text becomes lower-case words. Only places around a keyword are looked at:
each gives a window of words, the window meets the rules of its keyword in an
equi-join with the small rule table, and the rule's regular expression finds
the interval of words. Overlapping detections are resolved per document: one
that lies inside another of higher priority, or inside a longer one of the
same priority, is suppressed. All of it is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words of the scan: letters and digits of ASCII, and everything beyond ASCII.
SCAN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLANK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Words of a window before and after its keyword.
REACH = 14
PRIORITIES = 4
#: Stands before the keyword that a window is about, in windows and in rules.
MARK = "\x01"


#: Versions that exist of each license, as they stand in texts once cut into words.
GNU_VERSIONS = {
    "gpl": ("1 0", "2 0", "3 0", "1", "2", "3"),
    "lgpl": ("2 0", "2 1", "3 0", "2", "3"),
    "agpl": ("1 0", "3 0", "1", "3"),
}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: label, keyword, the license in full (`@` is the keyword), versions.
VERSIONED = [
    ("apache", "apache", "@ (?:software )?LICENSE", ("1 0", "1 1", "2 0", "2")),
    ("mpl", "mozilla", "@ public LICENSE", ("1 0", "1 1", "2 0", "2")),
    ("mpl", "mpl", "@", ("1 0", "1 1", "2 0")),
    ("npl", "netscape", "@ public LICENSE", ("1 0", "1 1")),
    ("epl", "eclipse", "@ public LICENSE", ("1 0", "2 0")),
    ("epl", "epl", "@", ("1 0", "2 0")),
    ("cpl", "public", "common @ LICENSE", ("1 0",)),
    ("ipl", "license licence", "ibm public @", ("1 0",)),
    ("cddl", "cddl", "@", ("1 0", "1 1")),
    ("artistic", "artistic", "@ LICENSE", ("1 0", "2 0")),
    ("afl", "license licence", "academic free @", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("osl", "license licence", "open software @", ("1 0", "2 0", "2 1", "3 0")),
    ("ecl", "license licence", "educational community @", ("1 0", "2 0")),
    ("eupl", "eupl", "@", ("1 0", "1 1", "1 2")),
    ("eupl", "union", "european @ public LICENSE", ("1 0", "1 1", "1 2")),
    ("gfdl", "documentation", "(?:gnu )?free @ LICENSE", ("1 1", "1 2", "1 3")),
    ("lppl", "latex", "@ project public LICENSE", ("1 0", "1 1", "1 2", "1 3")),
    ("lppl", "lppl", "@", ("1 0", "1 1", "1 2", "1 3")),
    ("ofl", "font", "(?:sil )?open @ LICENSE", ("1 0", "1 1")),
    ("boost", "boost", "@ software LICENSE", ("1 0",)),
    ("cecill", "cecill", "@(?: free software LICENSE agreement)?", ("1 0", "1 1", "2 0", "2 1")),
    ("zpl", "zope", "@ public LICENSE", ("1 1", "2 0", "2 1")),
    ("php", "license licence", "php @", ("3 0", "3 01")),
    ("apsl", "license licence", "apple public source @", ("1 0", "1 1", "1 2", "2 0")),
    ("rpl", "reciprocal", "@ public LICENSE", ("1 1", "1 5")),
    ("sspl", "public", "server side @ LICENSE", ("1",)),
    ("busl", "license licence", "business source @", ("1 1",)),
    ("elastic", "license licence", "elastic @", ("2 0",)),
    ("odbl", "database", "open (?:data commons )?(?:open )?@ LICENSE", ("1 0",)),
    ("pddl", "dedication", "public domain @ and LICENSE", ("1 0",)),
]
#: label, keywords, a license named in full.
NAMED = [
    ("cddl", "distribution", "common development and @ LICENSE"),
    ("ms-pl", "license licence", "microsoft public @"),
    ("ms-rl", "license licence", "microsoft reciprocal @"),
    ("qpl", "license licence", "(?:the )?qt public @"),
    ("ncsa", "license licence", "university of illinois (?:ncsa )?(?:open source )?@"),
    ("unlicense", "unlicense", "(?:the )?@"),
    ("wtfpl", "wtfpl", "@"),
    ("wtfpl", "fuck", "do what the @ you want to(?: public LICENSE)?"),
    ("beerware", "beerware", "(?:the )?@ LICENSE"),
    ("json", "license licence", "json @"),
    ("ftl", "freetype", "@ (?:project )?LICENSE"),
    ("sleepycat", "sleepycat", "@ (?:public )?LICENSE"),
    ("vim", "license licence", "vim @"),
    ("ruby", "license licence", "ruby @"),
    ("w3c", "license licence", "w3c (?:software )?(?:notice and )?@"),
    ("unicode", "license licence", "unicode (?:data files and software )?@"),
    ("curl", "license licence", "curl @"),
    ("x11", "license licence", "x11 @"),
    ("upl", "license licence", "universal permissive @"),
    ("blueoak", "license licence", "blue oak model @"),
    ("polyform", "polyform", "@ (?:noncommercial|shield|perimeter|strict|small business) LICENSE"),
    ("commons-clause", "clause", "commons @(?: LICENSE condition)?"),
    ("public-domain", "domain", "(?:in|into|to) the public @"),
    ("public-domain", "gemeinfrei", "@"),
    ("reserved", "reserved", "all rights (?:are )?@"),
    ("no-rights-reserved", "reserved", "no rights @"),
    ("some-rights-reserved", "reserved", "some rights @"),
    ("reserved", "réservés", "tous droits @"),
    ("reserved", "vorbehalten", "alle rechte @"),
    ("reserved", "reservados", "todos los derechos @"),
    ("reserved", "reservados", "todos os direitos @"),
    ("reserved", "riservati", "tutti i diritti @"),
]
#: label, keywords, a sentence that stands in a license or its notice.
SENTENCES = [
    ("mit", "granted", "permission is hereby @ free of charge"),
    ("isc", "modify", "permission to use copy @ and or distribute this software"),
    ("hpnd", "modify", "permission to use copy @ and distribute this software"),
    ("bsd", "redistribution", "@ and use in source and binary forms"),
    ("bsd", "redistributions", "@ of source code must retain"),
    ("bsd", "redistributions", "@ in binary form must reproduce"),
    ("bsd-3-clause", "endorse", "may be used to @ or promote products derived"),
    ("apache-2.0", "compliance", "may not use this file except in @ with the LICENSE"),
    ("gpl", "redistribute", "free software you can @ it and or modify"),
    ("gpl", "merchantability", "even the implied warranty of @ or fitness"),
    ("mpl-2.0", "mpl", "if a copy of the @ was not distributed"),
    ("epl", "accompanying", "this program and the @ materials are made available"),
    ("zlib", "misrepresented", "the origin of this software must not be @"),
    ("zlib", "altered", "@ source versions must be plainly marked"),
    ("unlicense", "unencumbered", "free and @ software released into the public domain"),
    ("cc0", "waived", "has (?:dedicated|@) (?:all )?(?:copyright|rights)"),
    ("ofl", "reserved", "with @ font name"),
    ("public-domain", "disclaims", "the author @ copyright to this source code"),
    ("no-warranty", "warranty", "without (?:any )?@(?: of any kind)?"),
    ("no-warranty", "warranties", "without @ or conditions of any kind"),
    ("no-warranty", "warranty", "(?:provided|distributed) as is without @"),
    ("spdx", "spdx", "@ LICENSE identifier"),
    ("noncommercial", "commercial", "(?:for )?non @ (?:use|purposes)(?: only)?"),
    ("noncommercial", "noncommercial", "(?:for )?@ (?:use|purposes)(?: only)?"),
    ("proprietary", "proprietary", "(?:confidential and @|@ and confidential)"),
    ("proprietary", "unauthorized", "@ (?:copying|use|reproduction|distribution)(?: of this file)?"),
]
#: label, keywords, words that hint at a license.
CLUES = [
    ("copyright", "copyright", r"@ (?:c )?(?:19|20)\d\d"),
    ("copyright", "copyright", "@ (?:c|by|holders?|notice)"),
    ("license-mention", "licensed licenced", "@ under(?: the)?"),
    ("license-mention", "license licence", "(?:this|the|terms of the) @"),
]


def _families() -> list[tuple[str, str, str, int, float]]:
    """label, keyword, regular expression over space-joined words, priority, weight.

    Priority 4: a versioned license; 3: a license named in full; 2: an
    abbreviation or a sentence of a license; 1: a clue. Only versions that
    exist have a rule. A rule finds up to `REACH` words on each side of its keyword.
    """
    lic, v = "licen[cs]e", "(?:version |v )?"
    out: list[tuple[str, str, str, int, float]] = []

    def add(label: str, words: str, regex: str, priority: int, weight: float) -> None:
        out.extend((label, w, regex.replace("LICENSE", lic), priority, weight) for w in words.split())

    def dotted(label: str, version: str) -> str:
        return f"{label}-{version.replace(' ', '.')}"

    later = ((" or (?:any )?later(?: version)?", "-or-later"), (" only", "-only"), ("", ""))
    ids: dict[str, str] = {}
    gnu = (("", "gpl", "1 2 3"), ("lesser ", "lgpl", "2 3"), ("library ", "lgpl", "2"), ("affero ", "agpl", "1 3"))
    for name, label, majors in gnu:
        full = f"(?:gnu )?{name}general @ LICENSE"
        for n in (n for n in GNU_VERSIONS[label] if n[0] in majors):
            for tail, form in later:
                add(dotted(label, n) + form, "public", f"{full} {v}{n}{tail}", 4, 1.0)
        add(label, "public", full, 3, 0.95)
    for abbr, versions in GNU_VERSIONS.items():
        for n in versions:
            for tail, form in later:
                add(dotted(abbr, n) + form, abbr, f"@ {v}{n}{tail}", 4, 0.95)
            if " " not in n:
                add(f"{abbr}-{n}", f"{abbr}v{n}", "@(?: or later| only)?", 4, 0.95)
        add(abbr, abbr, "(?:gnu )?@(?: LICENSEd?)?", 2, 0.7)
        ids |= {f"{abbr} {n}{tail}": dotted(abbr, n) + form for n in versions if " " in n for tail, form in later}
    kinds = {
        "by": "attribution",
        "by sa": "attribution share ?alike",
        "by nd": "attribution no ?derivatives",
        "by nc": "attribution non ?commercial",
        "by nc sa": "attribution non ?commercial share ?alike",
        "by nc nd": "attribution non ?commercial no ?derivatives",
    }
    for kind, full in kinds.items():
        label = f"cc-{kind.replace(' ', '-')}"
        for n in CC_VERSIONS:
            add(dotted(label, n), "cc", f"@ {kind} {v}{n}", 4, 1.0)
            add(dotted(label, n), "creative", f"@ commons {full}(?: LICENSE)? {v}{n}", 4, 1.0)
        add(label, "cc", f"@ {kind}", 3, 0.95)
        add(label, "creative", f"@ commons {full}(?: LICENSE)?", 3, 0.95)
    add("cc0", "cc0", "@(?: 1 0)?(?: universal)?", 3, 0.95)
    add("cc0", "creative", "@ commons (?:zero|0)(?: LICENSE)?", 3, 0.95)
    add("creative-commons", "creative", "@ commons(?: LICENSE)?", 2, 0.8)
    for label, word, full, versions in VERSIONED:
        for n in versions:
            add(dotted(label, n), word, f"{full} {v}{n}", 4, 1.0)
            if " " in n:
                ids[f"{label} {n}"] = dotted(label, n)
        named = "LICENSE" in full or word == "license licence"  # else an abbreviation
        add(label, word, full, 3 if named else 2, 0.95 if named else 0.7)
    for n in ("1 1", "2 0"):
        add(dotted("apache", n), "apache", f"@ {v}{n}", 4, 1.0)
    for name in ("mit", "isc", "zlib", "bsd", "bsd style", "openssl", "postgresql", "python software foundation"):
        label = name.split()[0]
        add(label, "license licence", f"(?:the )?{name} @", 3, 0.95)
        add(label, "licensed licenced", f"@ under (?:the )?{name}", 3, 0.95)
    for n in ("0", "2", "3", "4"):
        add(f"bsd-{n}-clause", "clause", f"(?:bsd {n} @|{n} @ bsd)(?: LICENSE)?", 4, 1.0)
    # the identifier line of a source file names the license by its short form
    ids |= {"mit": "mit", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense", "cc0 1 0": "cc0", "bsl 1 0": "boost-1.0"}
    ids |= {f"bsd {n} clause": f"bsd-{n}-clause" for n in ("2", "3", "4")}
    for words, label in ids.items():
        add(label, "spdx", f"@ LICENSE identifier {words}", 4, 1.0)
    for table, priority, weight in ((NAMED, 3, 0.95), (SENTENCES, 2, 0.8), (CLUES, 1, 0.4)):
        for label, words, regex in table:
            add(label, words, regex, priority, weight)
    return out


def rules(spark: SparkSession) -> DataFrame:
    """rule, label, keyword, pattern, priority, weight; fixed, a few hundred rows."""
    rows = [(i, label, word, regex.replace("@", MARK + word), p, w) for i, (label, word, regex, p, w) in enumerate(_families())]
    return spark.createDataFrame(rows, "rule int, label string, keyword string, pattern string, priority int, weight double")


def keywords() -> list[str]:
    return sorted({r[1] for r in _families()})


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _scan(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, its base places and its windows."""
    words = keywords()
    low = F.lower("text")
    some = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    # the words that start or end each base phrase are keywords as well
    gate = some & F.rlike(low, F.lit(rf"(?<![0-9a-z\x80-\x{{10ffff}}])(?:{'|'.join(words)})(?![0-9a-z\x80-\x{{10ffff}}])"))
    marked = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.regexp_count("text", F.lit(SCAN_WORD)).cast("long").alias("n_words"),
        # only a text with a keyword is cut into words; every word then has one space on either side
        F.when(gate | F.contains("text", F.lit("K")), F.concat(F.lit(" "), F.trim(F.regexp_replace("text", BLANK, " ")), F.lit(" "))).alias("line"),
    )
    marked = marked.withColumn("line", F.translate("line", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for i, (phrase, _) in enumerate(BASE):
        first, _, rest = phrase.partition(" ")
        pieces = F.split("line", f"(?<= ){first}(?= {rest} )")
        marked = (
            marked.withColumn("pieces", pieces)
            .withColumn(f"n{i}", F.coalesce(F.size("pieces") - 1, F.lit(0)).cast("long"))
            .withColumn(f"first{i}", F.when(F.col(f"n{i}") > 0, _spaces(F.element_at("pieces", 1)) - 1).cast("long"))
            .withColumn(f"last{i}", F.when(F.col(f"n{i}") > 0, F.col("n_words") - _spaces(F.element_at("pieces", -1))).cast("long"))
            .drop("pieces")
        )
    several = len(BASE)
    labels = F.array_compact(F.array(*[F.when(F.col(f"n{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    listed = F.array(*[F.lit(w) for w in words])
    cut = F.split(F.trim("line"), " ")
    places = F.filter(F.transform(F.col("cut"), lambda w, i: F.when(F.array_contains(listed, w), i)), lambda i: i.isNotNull())

    def window(i: Column) -> Column:
        at = F.greatest(i - REACH, F.lit(0))
        before, after = F.array_join(F.slice("cut", at + 1, i - at), " "), F.array_join(F.slice("cut", i + 1, F.lit(REACH + 1)), " ")
        around = F.concat(F.lit(" "), before, F.when(i > 0, F.lit(" ")).otherwise(F.lit("")), F.lit(MARK), after, F.lit(" "))
        return F.struct(at.alias("at"), F.element_at("cut", i + 1).alias("keyword"), around.alias("around"))

    return (
        marked.withColumn("cut", cut)
        .withColumn("windows", F.transform(places, window))
        .select(
            "doc_id",
            "row",
            "n_words",
            sum((F.col(f"n{i}") for i in range(1, several)), F.col("n0")).alias("n_base"),
            F.least(*[f"first{i}" for i in range(several)]).alias("first_word"),
            F.greatest(*[f"last{i}" for i in range(several)]).alias("last_word"),
            labels.alias("base"),
            "windows",
        )
    )


def detections(scanned: DataFrame) -> DataFrame:
    """Every rule's interval in every window; documents without any keep a row."""
    table = rules(scanned.sparkSession)
    placed = scanned.withColumn("w", F.explode_outer("windows")).drop("windows")
    found = placed.join(F.broadcast(table), F.col("w.keyword") == F.col("keyword"), "left")
    pattern = F.concat(F.lit("(?<= )"), F.col("pattern"), F.lit("(?= )"))
    hit = F.regexp_substr("w.around", pattern)
    start = F.col("w.at") + _spaces(F.substring(F.col("w.around"), F.lit(1), F.regexp_instr("w.around", pattern))) - 1
    return (
        found.withColumn("hit", hit)
        .withColumn("start", F.when(F.col("hit").isNotNull(), start))
        .withColumn("end", F.when(F.col("hit").isNotNull(), F.col("start") + _spaces(F.col("hit")) + 1))
        .withColumn("priority", F.when(F.col("hit").isNotNull(), F.col("priority")))
        .drop("w", "pattern", "keyword")
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    `found` lists the detections that stand: start and end word, label,
    priority. The score is 1 minus the product of (1 - weight) over the
    distinct standing labels, base phrases counting 0.95. A null text counts
    as empty: no words, no places, empty labels, score 0. Rows with the same
    doc_id stay apart. An empty table gives no row; columns other than doc_id
    and text are ignored.
    """
    hits = detections(_scan(docs))
    inside = W.partitionBy("row").orderBy(F.col("start"), F.col("end").desc(), F.col("priority").desc(), "rule")
    reach = [
        F.max(F.when(F.col("priority") >= p, F.col("end"))).over(inside.rowsBetween(W.unboundedPreceding, -1)) for p in range(1, PRIORITIES + 1)
    ]
    covered = F.element_at(F.array(*reach), F.col("priority"))
    standing = hits.withColumn("covered", covered)
    alive = F.col("hit").isNotNull() & (F.coalesce(F.col("covered"), F.lit(-1)) < F.col("end"))
    one = F.when(alive, F.struct("start", "end", "label", "priority", "weight"))
    grouped = standing.groupBy("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base").agg(F.collect_set(one).alias("found"))
    base_weights = F.transform("base", lambda b: F.struct(b.alias("label"), F.lit(0.95).alias("weight")))
    own = F.transform("found", lambda h: F.struct(h["label"].alias("label"), h["weight"].alias("weight")))
    names = F.array_sort(F.array_distinct(F.concat("base", F.transform("found", lambda h: h["label"]))))
    best = F.transform(
        names,
        lambda n: F.array_max(F.transform(F.filter(F.concat(base_weights, own), lambda h: h["label"] == n), lambda h: h["weight"])),
    )
    return grouped.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(names, ",").alias("labels"),
        F.round(1 - F.aggregate(best, F.lit(1.0), lambda a, w: a * (1 - w)), 6).alias("score"),
        F.array_sort("found").alias("found"),
    )
