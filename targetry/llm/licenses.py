"""License scans by ordered signature rules, with DataFrame and SQL functions only: rules written by hand (license_rules), and
grants, titles and identifiers of families of licenses.

A text's words are joined by single spaces. If it holds the longest word of no rule's keyword, it is left at once. Otherwise
each rule whose keyword it holds is matched as a regular expression on the lower-cased words, and a detection is suppressed if one of at least its
priority contains its interval (of equal intervals with equal priority that of the first label in order stays).

Null texts count as empty: no words, no labels, score 0. Repeated rows are scanned each on its own, and so are long texts,
whole. An empty table gives an empty result. Intervals are in words from 0, the end exclusive.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from targetry.llm.common import WORD_PATTERN
from targetry.llm.license_rules import written

#: Phrases that always count wherever their words stand in a row, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Families: label, names in words, versions. Names are fixed values: licenses as their texts call them.
FAMILIES = (
    ("mit", "mit|expat", ""),
    ("mit-0", "mit no attribution|mit 0", ""),
    ("apache", "apache|apache software", "1 0|1 1|2 0|2"),
    ("bsd", "bsd|berkeley software distribution", "2 clause|3 clause|4 clause"),
    ("gpl", "gnu general public|gnu gpl|gpl", "1|2|3|2 0|3 0"),
    ("lgpl", "gnu lesser general public|gnu library general public|gnu lgpl|lgpl", "2|2 0|2 1|3|3 0"),
    ("agpl", "gnu affero general public|affero general public|gnu agpl|agpl", "3|3 0"),
    ("gfdl", "gnu free documentation|gfdl", "1 1|1 2|1 3"),
    ("mpl", "mozilla public|mpl", "1 0|1 1|2 0"),
    ("epl", "eclipse public|epl", "1 0|2 0"),
    ("edl", "eclipse distribution", "1 0"),
    ("cddl", "common development and distribution|cddl", "1 0|1 1"),
    ("cpl", "common public", "1 0"),
    ("ipl", "ibm public", "1 0"),
    ("eupl", "european union public|eupl", "1 0|1 1|1 2"),
    ("artistic", "artistic", "1 0|2 0"),
    ("bsl", "boost software", "1 0"),
    ("busl", "business source", "1 1"),
    ("isc", "isc|internet systems consortium", ""),
    ("zlib", "zlib|zlib libpng", ""),
    ("unlicense", "unlicense", ""),
    ("wtfpl", "do what the fuck you want to public|wtfpl", "2"),
    ("psf", "python software foundation", "2"),
    ("php", "php", "3 0|3 01"),
    ("ruby", "ruby", ""),
    ("ofl", "sil open font|open font", "1 0|1 1"),
    ("upl", "universal permissive", "1 0"),
    ("ncsa", "university of illinois ncsa open source|ncsa open source", ""),
    ("ms-pl", "microsoft public", ""),
    ("ms-rl", "microsoft reciprocal", ""),
    ("osl", "open software", "1 0|2 0|2 1|3 0"),
    ("afl", "academic free", "2 1|3 0"),
    ("apsl", "apple public source", "1 0|2 0"),
    ("qpl", "q public", "1 0"),
    ("sspl", "server side public", "1"),
    ("elastic", "elastic", "2 0"),
    ("odbl", "open database|odbl", "1 0"),
    ("odc-by", "open data commons attribution", "1 0"),
    ("pddl", "public domain dedication and license", "1 0"),
    ("cecill", "cecill", "1 0|2 0|2 1"),
    ("postgresql", "postgresql", ""),
    ("openssl", "openssl", ""),
    ("vim", "vim", ""),
    ("w3c", "w3c software notice and|w3c", ""),
    ("zpl", "zope public", "2 0|2 1"),
    ("bcl", "oracle binary code", ""),
    ("json", "json", ""),
    ("curl", "curl", ""),
    ("libpng", "libpng|png reference library", "2"),
    ("mulan", "mulan permissive software|mulan psl", "1|2"),
)
_CC = (("by", "attribution"), ("nc", "non ?commercial"), ("sa", "share ?alike"), ("nd", "no ?derivatives"))


def rules() -> Iterator[tuple[str, str, str, int, float]]:
    """label, keyword, pattern, priority, confidence.

    A family gives for each name a grant, a title and an identifier, and each of them for each version once more. A title
    without a version has to say license; the clauses of a version stand before or after the name.
    """
    for label, names, versions in FAMILIES:
        for name in names.split("|"):
            word = name.split(" ")[0] if len(name.split(" ")[0]) > 2 else name
            for v in [x for x in versions.split("|") if x] + [None]:
                own = label if v is None else f"{label}-{v.replace(' ', '.').replace('.clause', '-clause')}"
                at = "" if v is None else f"(?: license)?(?: version)?(?: v)? {v}" if "clause" not in v else f" {v}"
                if v is not None and "clause" in v:
                    at, name_v = "", f"(?:{v} {name}|{name}(?: license)? {v})"
                else:
                    name_v = name
                extra = 0 if v is None else 1
                yield own, word, f"(?:licensed|released|distributed|available|published|provided) under(?: the terms of)?(?: the| an?)? {name_v}{at}(?: license)?(?: or later)?", 4 + extra, 1.0
                yield own, word, f"{name_v}{at} license|the {name_v} license{at}" if v is None else f"{name_v}{at}(?: license)?", 2 + extra, 0.8
        yield label, "spdx", f"spdx license identifier {label.replace('-', ' ')}(?: [0-9]+)*(?: or later| only)?", 6, 1.0
    for k in range(1, 1 << len(_CC)):
        parts = [c for i, c in enumerate(_CC) if k >> i & 1]
        if parts[0][0] == "by":
            label = "cc-" + "-".join(c[0] for c in parts)
            yield label, "cc", "cc " + " ".join(c[0] for c in parts) + "(?: [1-4] [0-9])?", 2 + len(parts), 0.9
            yield label, "creative commons", "creative commons " + " ".join(c[1] for c in parts) + "(?: license)?(?: [1-4] [0-9])?", 3 + len(parts), 1.0
    yield from written()


PRIORITIES = 9
#: Detections of a text are swept in blocks of this many, so that no array grows by one element at a time.
SWEPT = 256


def _spaces(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ' ', '')))"


def _let(value: str, name: str, body: str) -> str:
    """body, in which name stands for value, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _sums(array: str) -> str:
    """Running sums of an array that isn't empty, by doubling: work grows as n log n."""
    return f"aggregate(sequence(0, int(log2(size({array})))), {array}, (a, k) -> transform(a, (x, i) -> x + IF(i >= shiftleft(1, k), a[i - shiftleft(1, k)], 0)))"


def scan(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with words (long), base (array of struct(label, start, end)) and found (array of struct(start, end,
    priority, label, confidence), what is left of the rules' detections) added; columns of these names are replaced."""
    words, base, found = (f"{prefix}{c}" for c in ("words", "base", "found"))
    docs = docs.drop(words, base, found)
    table = list(rules())
    keywords = sorted({r[1] for r in table})
    number = {k: i for i, k in enumerate(keywords)}
    as_json = json.dumps([{"k": number[k], "x": f" (?:{x})(?= )", "p": p, "l": label, "n": n, "c": c} for n, (label, k, x, p, c) in enumerate(table)])
    # the gate, on the longest words of keywords: every match of a rule holds its keyword as whole words
    joined = F.trim(F.regexp_replace(F.col(text), WORD_PATTERN.replace("[^", "["), " "))
    asked = sorted({max(k.split(" "), key=len) for k in [*keywords, *(phrase for phrase, _ in PHRASES)]})
    # lower() may make ASCII letters of others, which only lets more texts through
    out = docs.withColumn("_t", joined).withColumn("_all", F.split(F.lower("_t"), " "))
    gate = F.arrays_overlap("_all", F.array(*map(F.lit, asked)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = out.withColumn(words, F.when(F.length("_t") > 0, F.size("_all")).otherwise(0).cast("long"))
    out = out.withColumn("_j", F.when(gate, F.concat(F.lit(" "), F.translate("_t", upper, upper.lower()), F.lit(" ")))).drop("_t", "_all")
    said = " OR ".join(f"contains(_j, ' {phrase} ')" for phrase, _ in PHRASES)
    out = out.withColumn("_w", F.expr(f"CASE WHEN {said} THEN split(trim(_j), ' ') END"))
    places = []
    for phrase, label in PHRASES:
        own = phrase.split(" ")
        stand = " AND ".join(f"_w[i + {k}] = '{w}'" for k, w in enumerate(own))
        places.append(f"""CASE WHEN contains(_j, ' {phrase} ') THEN transform(filter(sequence(0, size(_w) - {len(own)}), i -> {stand}),
            i -> named_struct('label', '{label}', 'start', bigint(i), 'end', bigint(i + {len(own)}))) ELSE array() END""")
    # the keywords that occur, the rules they open, and each rule's matches with their places in words
    rule_type = "array<struct<k:int,x:string,p:int,l:string,n:int,c:double>>"
    out = out.withColumn(base, F.expr(f"CASE WHEN _j IS NULL THEN array() ELSE concat({', '.join(places)}) END"))
    out = out.withColumn("_hit", F.expr(f"CASE WHEN _j IS NOT NULL THEN transform(from_json('{json.dumps(keywords)}', 'array<string>'), k -> contains(_j, concat(' ', k, ' '))) END"))
    open_rules = F.expr("filter(_rules, r -> _hit[r.k])")
    out = out.withColumn("_rules", F.from_json(F.lit(as_json), rule_type)).withColumn("_open", F.when(F.col("_hit").isNotNull(), open_rules)).drop("_rules", "_hit")
    # a rule's matches are set between marks, which no text holds here, in one scan: words up to the marks say where they are.
    # The order of fields is the order of the sweep: containers come first
    raw = "array<struct<start:bigint,back:bigint,low:int,label:string,rule:int,confidence:double>>"
    pieces = "split(regexp_replace(_j, r.x, '\\u0001$0\\u0001'), '\\u0001', -1)"
    lengths = f"transform(slice(p, 1, size(p) - 1), x -> {_spaces('x')})"
    matches = "transform(sequence(0, int(size(c) div 2) - 1), j -> named_struct('start', bigint(c[2 * j]), 'back', -bigint(c[2 * j + 1]), 'low', -r.p, 'label', r.l, 'rule', r.n, 'confidence', r.c))"
    detections = _let(pieces, "p", f"IF(size(p) < 2, CAST(array() AS {raw}), {_let(lengths, 'l', _let(_sums('l'), 'c', matches))})")
    out = out.withColumn("_found", F.expr(f"CASE WHEN size(_open) > 0 THEN array_sort(flatten(transform(_open, r -> {detections}))) END"))
    # ends[p] is the furthest end so far of priority p or more
    blocks = f"transform(sequence(0, int((size(_found) - 1) div {SWEPT})), b -> slice(_found, b * {SWEPT} + 1, {SWEPT}))"
    block = f"""aggregate(d, named_struct('ends', w.ends, 'kept', CAST(array() AS {raw})),
        (a, x) -> IF(a.ends[-x.low] >= -x.back, a, named_struct('ends', transform(a.ends, (e, i) -> IF(i <= -x.low, greatest(e, -x.back), e)), 'kept', concat(a.kept, array(x)))),
        a -> named_struct('ends', a.ends, 'kept', concat(w.kept, array(a.kept))))"""
    kept = f"aggregate({blocks}, named_struct('ends', array_repeat(bigint(0), {PRIORITIES + 1}), 'kept', CAST(array() AS array<{raw}>)), (w, d) -> {block}, w -> flatten(w.kept))"
    final = "x -> named_struct('start', x.start, 'end', -x.back, 'priority', -x.low, 'label', x.label, 'confidence', x.confidence)"
    out = out.withColumn(found, F.expr(f"CASE WHEN size(_found) > 0 THEN transform({kept}, {final}) ELSE CAST(array() AS array<struct<start:bigint,end:bigint,priority:int,label:string,confidence:double>>) END"))
    return out.drop("_w", "_j", "_open", "_found")
