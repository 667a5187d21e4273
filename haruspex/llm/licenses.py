"""License scans by ordered signature rules, with DataFrame operations only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haruspex.llm import common as C

#: A word before lower-casing, and what separates words.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same in Java's classes, for every character of every text: each of a list of ranges would be tried in turn, many times slower.
JAVA_WORD = r"[\p{Alnum}\P{ASCII}]++"
JAVA_BREAK = r"[^\p{Alnum}\P{ASCII}]++"

#: Phrase and label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Rule:
    """``pattern`` is over words that are each preceded by one space; rules of a higher priority suppress those inside them."""

    label: str
    priority: int  # 1 to 4
    weight: float
    keyword: str  # a text without it can't match
    pattern: str


def _version(v: str) -> str:
    """A version's words: ``3.0`` is ``3 0``, and ``3`` may stand for it."""
    major, _, minor = v.partition(".")
    return f"{major} {minor}" if minor not in ("", "0") else f"{major}(?: 0)?"


def _rules() -> tuple[Rule, ...]:
    out: list[Rule] = []

    def add(label: str, priority: int, weight: float, keyword: str, *patterns: str) -> None:
        out.extend(Rule(label, priority, weight, keyword, p) for p in patterns)

    # Creative Commons: kind x version, by short name, full name and address
    kinds = {
        "by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s?",
        "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike",
        "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?",
    }
    for kind, name in kinds.items():
        short = kind.replace("-", " ")
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            ver = _version(v)
            add(f"cc-{kind}-{v}", 4, 1.0, "cc", f"cc {short} {ver}")
            add(f"cc-{kind}-{v}", 4, 1.0, "creative", f"creative commons {name}(?: (?!licen|share|no|non)\\S+){{0,2}}(?: licen[cs]e)?(?: version)? {ver}")
            add(f"cc-{kind}-{v}", 4, 1.0, "creativecommons", f"creativecommons org licenses {short} {ver}")
        add(f"cc-{kind}", 2, 0.8, "cc", f"cc {short}")
        add(f"cc-{kind}", 2, 0.8, "creative", f"creative commons {name}")
    add("cc0-1.0", 4, 1.0, "cc0", "cc0 1 0(?: universal)?", "cc0")
    add("cc0-1.0", 4, 1.0, "creativecommons", "creativecommons org publicdomain zero 1 0")
    add("cc-generic", 1, 0.5, "creative", "creative commons(?: licen[cs]e)?")

    # GNU: family x version x "only" or "or later", by short and full name
    families = {
        "gpl": "(?:gnu )?general public licen[cs]e", "lgpl": "(?:gnu )?(?:lesser|library) general public licen[cs]e",
        "agpl": "(?:gnu )?affero general public licen[cs]e", "gfdl": "(?:gnu )?free documentation licen[cs]e",
    }
    versions = {"gpl": ("1.0", "2.0", "3.0"), "lgpl": ("2.0", "2.1", "3.0"), "agpl": ("1.0", "3.0"), "gfdl": ("1.1", "1.2", "1.3")}
    for fam, name in families.items():
        key = "documentation" if fam == "gfdl" else "public"
        for v in versions[fam]:
            ver = _version(v)
            add(f"{fam}-{v}", 3, 1.0, key, f"{name}(?: as published by the free software foundation(?: either)?)?(?: version| v)? ?{ver}")
            add(f"{fam}-{v}-or-later", 4, 1.0, key, f"{name}(?: as published by the free software foundation(?: either)?)?(?: version| v)? ?{ver}(?: of the licen[cs]e)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?")
            add(f"{fam}-{v}-only", 4, 1.0, key, f"{name}(?: version| v)? ?{ver} only")
            add(f"{fam}-{v}", 3, 0.9, fam, f"(?:gnu )?{fam} ?v?(?:ersion )?{ver}")
            add(f"{fam}-{v}-or-later", 4, 1.0, fam, f"{fam} ?v?{ver} or later", f"{fam}{v[0]}\\+")
            add(f"{fam}-{v}-only", 4, 1.0, fam, f"{fam} ?v?{ver} only")
        add(fam, 2, 0.7, key, name)
        add(fam, 1, 0.4, fam, f"gnu {fam}", f"{fam} licen[cs]ed?")

    # Named licenses with versions
    for label, key, name, vs in (
        ("apache", "apache", "apache(?: software)?(?: licen[cs]e)?", ("1.0", "1.1", "2.0")),
        ("mpl", "mozilla", "mozilla public licen[cs]e", ("1.0", "1.1", "2.0")),
        ("epl", "eclipse", "eclipse public licen[cs]e", ("1.0", "2.0")),
        ("cddl", "distribution", "common development and distribution licen[cs]e", ("1.0", "1.1")),
        ("eupl", "european", "european union public licen[cs]e", ("1.0", "1.1", "1.2")),
        ("artistic", "artistic", "artistic licen[cs]e", ("1.0", "2.0")),
        ("bsl", "boost", "boost software licen[cs]e", ("1.0",)),
        ("osl", "open", "open software licen[cs]e", ("1.0", "2.0", "2.1", "3.0")),
        ("afl", "academic", "academic free licen[cs]e", ("1.1", "1.2", "2.0", "2.1", "3.0")),
        ("ofl", "font", "(?:sil )?open font licen[cs]e", ("1.0", "1.1")),
        ("php", "php", "php licen[cs]e", ("3.0", "3.01")),
        ("zpl", "zope", "zope public licen[cs]e", ("1.1", "2.0", "2.1")),
        ("lppl", "latex", "latex project public licen[cs]e", ("1.0", "1.1", "1.2", "1.3")),
        ("cpl", "common", "common public licen[cs]e", ("1.0",)),
        ("ms-pl", "microsoft", "microsoft public licen[cs]e", ("1.0",)),
        ("odbl", "database", "open database licen[cs]e", ("1.0",)),
        ("psf", "python", "python software foundation licen[cs]e", ("2.0",)),
        ("ecl", "educational", "educational community licen[cs]e", ("1.0", "2.0")),
    ):
        for v in vs:
            add(f"{label}-{v}", 3, 1.0, key, f"{name}(?: version| v)? ?{_version(v)}")
        add(label, 2, 0.7, key, name if label != "apache" else "apache(?: software)? licen[cs]e")

    # Signature sentences of licenses without versions
    add("mit", 3, 1.0, "hereby", "permission is hereby granted free of charge to any person obtaining a copy")
    add("mit", 2, 0.8, "mit", "(?:the )?mit licen[cs]ed?", "licensed under (?:the )?mit")
    add("x11", 3, 0.9, "x11", "x11 licen[cs]e")
    add("isc", 3, 1.0, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted")
    add("isc", 2, 0.7, "isc", "isc licen[cs]e")
    add("bsd-3-clause", 4, 1.0, "endorse", "neither the name of(?: \\S+){1,12} may be used to endorse or promote products")
    add("bsd-2-clause", 3, 0.9, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met")
    for n, word in ((0, "zero"), (2, "two"), (3, "three"), (4, "four")):
        add(f"bsd-{n}-clause", 3, 1.0, "bsd", f"(?:{n}|{word}) clause bsd(?: licen[cs]e)?", f"bsd (?:{n}|{word}) clause(?: licen[cs]e)?")
    add("bsd", 2, 0.6, "bsd", "bsd(?: style)? licen[cs]e")
    add("apache-2.0", 3, 1.0, "apache", "licensed under the apache licen[cs]e version 2 0", "www apache org licenses license 2 0")
    add("zlib", 3, 1.0, "altered", "altered source versions must be plainly marked as such and must not be misrepresented")
    add("zlib", 2, 0.7, "zlib", "zlib(?: libpng)? licen[cs]e")
    add("unlicense", 3, 1.0, "unencumbered", "this is free and unencumbered software released into the public domain")
    add("unlicense", 2, 0.7, "unlicense", "(?:the )?unlicense")
    add("wtfpl", 3, 0.9, "wtfpl", "wtfpl")
    add("public-domain", 2, 0.7, "domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain")
    add("public-domain", 1, 0.4, "domain", "public domain")
    add("vim", 2, 0.7, "vim", "vim licen[cs]e")
    add("openssl", 2, 0.8, "openssl", "openssl licen[cs]e")
    add("curl", 2, 0.7, "curl", "curl licen[cs]e")
    add("ncsa", 2, 0.8, "ncsa", "(?:university of illinois )?ncsa open source licen[cs]e")
    add("ruby", 2, 0.6, "ruby", "ruby licen[cs]e")
    add("beerware", 2, 0.6, "beer", "beer ?ware licen[cs]e")
    add("as-is", 1, 0.4, "warrant", "provided as is without (?:any )?(?:express or implied )?warrant(?:y|ies)")
    add("proprietary", 3, 0.8, "confidential", "proprietary and confidential", "confidential and proprietary")
    add("proprietary", 2, 0.7, "proprietary", "proprietary licen[cs]e")
    add("proprietary", 2, 0.7, "unauthorized", "unauthorized (?:copying|reproduction|distribution)(?: \\S+){0,8} prohibited")
    add("eula", 2, 0.7, "end", "end user licen[cs]e agreement")
    add("non-commercial", 2, 0.7, "commercial", "(?:for )?non ?commercial (?:use|purposes) only")
    add("no-redistribution", 2, 0.7, "permission", "(?:may|must) not be (?:redistributed|reproduced|copied)(?: \\S+){0,4} without(?: \\S+){0,4} permission")
    add("reserved", 2, 0.7, "reserved", "all rights (?:are )?reserved", "some rights reserved")
    add("copyright", 1, 0.4, "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?(?: by)?(?: \\S+){1,4}")
    add("permission", 1, 0.4, "permission", "(?:used|reprinted|reproduced) (?:with|by) permission")
    add("licensed", 1, 0.3, "licen", "(?:is |are )?(?:licensed|available|distributed|released) under(?: \\S+){1,6}? licen[cs]e")
    return tuple(out)


RULES = _rules()


def _mark(rule: Rule) -> str:
    """What a raw text must hold for the rule to match: its keyword, or words that its pattern can't do without and that are rarer."""
    need, before = rule.pattern, ""
    while need != before:  # what lies outside of groups is in every match
        before, need = need, re.sub(r"\((?:\?[:!])?[^()]*\)(?:\?|\{\d+,\d+\}\??)?", "~", need)
    if "licen" in need:
        return "licen"
    if re.search("rights ~?reserved", need):
        return rf"rights{RAW_BREAK}(?:are{RAW_BREAK})?reserved"
    if "public domain" in need:
        return rf"public{RAW_BREAK}domain"
    if need.startswith("cc "):
        return f"(?<!{RAW_WORD[:-1]})cc(?!{RAW_WORD[:-1]})"
    return rule.keyword


def gate(rules: tuple[Rule, ...]) -> str:
    """Matches any raw text in which a rule or a base phrase can match."""
    base = tuple(Rule(label, 1, 0.0, phrase.split()[-1], phrase) for phrase, label in BASE)
    marks = sorted({_mark(r) for r in (*base, *rules)})
    heads: dict[str, list[str]] = {}
    for m in marks:
        heads.setdefault(re.sub(r"^\(\?<![^()]*\)", "", m)[0], []).append(m)
    if not all(h.isalnum() for h in heads):
        return "(?i)" + "|".join(marks)
    # marks are tried only where the first letter of one stands, and those of another letter are left out at once
    tails = [f"{h}(?:{'|'.join(t)})" for h, ms in heads.items() if (t := [m[1:] for m in ms if m[0] == h])]
    return f"(?i)(?=[{''.join(heads)}])(?:{'|'.join(tails + [m for h, ms in heads.items() for m in ms if m[0] != h])})"


def _literal(rules: tuple[Rule, ...]) -> str:
    """An SQL array of the rules; a constant that the optimizer folds."""
    one = "named_struct('label', '{0.label}', 'p', {0.priority}, 'w', {0.weight}D, 'kw', '{0.keyword}', 'rx', r'{1}')"
    return "array(" + ", ".join(one.format(r, f" (?:{r.pattern})(?= )") for r in rules) + ")"


def license_scan(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with base places and labels, and the labels and score that the rules add.

    Texts that hold no keyword are counted only.  Others are brought to lower-case
    words with one space before each; a rule is tried if the text holds its
    keyword.  Its matches are intervals of characters.  Sorted by start and
    descending end, an interval inside another of the same or a higher priority is
    suppressed.  ``labels`` are those of what remains and of the base phrases;
    ``score`` is the largest weight of what remains, 0 without any.

    * Null text counts as empty: no words, no labels, score 0.
    * Repeated rows are scanned alike; input columns named like a new one give way.
    * Empty input: empty result.
    """
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    cols = [c for c in (docs.columns if keep is None else keep) if c not in made]
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(raw, upper, upper.lower()), JAVA_BREAK, " ")), F.lit(" "))
    df = docs.select(*[F.col(f"`{c}`") for c in cols], F.regexp_count(raw, F.lit(JAVA_WORD)).cast("long").alias("n_words"), F.when(raw.rlike(gate(rules)), norm).alias("__norm"))

    places, firsts, lasts, base = [], [], [], []
    for phrase, label in BASE:
        parts = F.split(F.col("__norm"), f" {phrase}(?= )")
        n = F.size(parts) - 1
        spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
        some = F.col("__norm").isNotNull() & F.contains(F.col("__norm"), F.lit(f" {phrase} "))
        places.append(F.when(some, n).otherwise(0))
        firsts.append(F.when(some, spaces(F.element_at(parts, 1))))
        lasts.append(F.when(some, F.col("n_words") - (spaces(F.element_at(parts, -1)) - 1) - len(phrase.split())))
        base.append(F.when(some, F.lit(label)))
    df = df.select(
        *cols, "n_words", "__norm",
        sum(places[1:], places[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*base))).alias("__base"),
    )
    gaps = "zip_with(split(__norm, r.rx), regexp_extract_all(__norm, r.rx, 0), (p, m) -> named_struct('gap', length(p), 'len', length(m)))"
    spans = (
        f"aggregate({gaps}, named_struct('at', 0, 'out', cast(array() AS array<struct<s:int,e:int>>)), "
        "(acc, z) -> named_struct('at', acc.at + z.gap + coalesce(z.len, 0), 'out', if(z.len IS NULL, acc.out, concat(acc.out, array(named_struct('s', acc.at + z.gap, 'e', acc.at + z.gap + z.len))))), acc -> acc.out)"
    )
    found = (
        f"flatten(transform(filter({_literal(rules)}, r -> contains(__norm, r.kw)), "
        f"r -> transform({spans}, x -> named_struct('s', x.s, 'ne', -x.e, 'np', -r.p, 'label', r.label, 'w', r.w))))"
    )
    inside = "(-x.ne <= (CASE -x.np WHEN 1 THEN acc.m1 WHEN 2 THEN acc.m2 WHEN 3 THEN acc.m3 ELSE acc.m4 END))"
    ends = ", ".join(f"'m{k}', if(NOT {inside} AND -x.np >= {k}, greatest(acc.m{k}, -x.ne), acc.m{k})" for k in range(1, 5))
    kept = (
        f"aggregate(array_sort({found}), named_struct('m1', -1, 'm2', -1, 'm3', -1, 'm4', -1, 'labels', cast(array() AS array<string>), 'score', 0.0D), "
        f"(acc, x) -> named_struct({ends}, 'labels', if({inside}, acc.labels, array_union(acc.labels, array(x.label))), 'score', if({inside}, acc.score, greatest(acc.score, x.w))))"
    )
    df = df.withColumn("__kept", F.when(F.col("__norm").isNotNull(), F.expr(kept)))
    return df.select(
        *cols, "n_words", "n_base", "first_word", "last_word",
        F.array_join("__base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.col("__base"), F.coalesce(F.col("__kept.labels"), F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce(F.col("__kept.score"), F.lit(0.0)).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(C.load(spark, sf_dir, "documents"), keep=["doc_id"])
