"""Operator 1, licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences at line ends and at `.`, `!`, `?` or `;` before white space, and each sentence is normalised:
lower case, everything but letters, digits and `+` and the points inside numbers becomes one space, and -ise/-ce spellings of
"license" are made one. A normalised sentence that matches a pattern of SENTENCES gets that pattern's identifier; the first
pattern in order counts. So that wrapped notices are found, lines are also joined up to a blank line or to `.`, `!` or `?` (not
that of `v.`) before white space. What a joined sentence matches is added before the identifiers of its parts, if none of them
has it, and takes the place of a less specific one (a denial that of all); for these, LONGER holds further patterns. The identifiers of a document, in order, are then matched against RULES from first to last: a rule is
an ordered sequence of identifiers, and what it matches is replaced by the rule's licence, so that longer rules take their
sentences before shorter ones see them. Identifiers that no rule takes are reported as left over.

Only the sentences that hold one of the KEYWORDS, without one of which no pattern matches, are normalised.

Result: one row for each document: doc_id, n_sentences (with an identifier), sentence_ids, licenses (distinct, sorted), left_over,
each joined by commas. Defined results: a null or empty text has none of them (0 and empty strings); a null id is scanned as
any other; repeated rows each give a row; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import let, table

#: Words without which no sentence pattern can match; of the raw text in lower case.
KEYWORDS = "licen|copyright|warrant|permission|redistribut|public domain|spdx|endorse|cc0|all rights"
#: (identifier, pattern over the normalised sentence); the first that matches counts.
SENTENCES = [
    ("not-licensed", r"\b(not|isn t|aren t|never|no longer) ([a-z]+ )?([a-z]+ )?(licensed|released|distributed|available) under\b"),
    ("spdx-apache2", r"spdx license identifier apache 2\.0"),
    ("spdx-mit", r"spdx license identifier mit\b"),
    ("spdx-gpl3", r"spdx license identifier gpl 3\.0"),
    ("spdx-bsd3", r"spdx license identifier bsd 3 clause"),
    ("apache2", r"licensed under the apache license,? version 2\.0"),
    ("apache2-may-not", r"you may not use this file except in compliance with the license"),
    ("as-is-apache", r"distributed under the license is distributed on an as is basis"),
    ("cc-by-nc4", r"licensed under (a |the )?(cc by nc|creative commons attribution non ?commercial)( international)?( license)? 4\.0"),
    ("cc-by-sa4", r"licensed under (a |the )?(cc by sa|creative commons attribution share ?alike)( international)?( license)? 4\.0"),
    ("cc-by4", r"licensed under (a |the )?(cc by|creative commons attribution)( international)?( license)? 4\.0"),
    ("cc0", r"\bcc0\b|dedicated to the public domain"),
    ("agpl3", r"gnu affero general public license"),
    ("lgpl", r"gnu (lesser|library) general public license"),
    ("gpl3-or-later", r"gnu general public license.*(version )?3.*any later version"),
    ("gpl3", r"gnu general public license,?( version)? 3"),
    ("gpl2", r"gnu general public license,?( version)? 2"),
    ("gpl-no-warranty", r"without even the implied warranty of merchantability"),
    ("mit", r"(released|licensed|distributed|available) under (the )?mit license"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-condition", r"the above copyright notice and this permission notice shall be included"),
    ("mit-warranty", r"the software is provided as is without warranty of any kind"),
    ("isc-grant", r"permission to use copy modify and(/or| or)? distribute this software for any purpose"),
    ("bsd-grant", r"redistribution and use in source and binary forms"),
    ("bsd-source", r"redistributions of source code must retain"),
    ("bsd-binary", r"redistributions in binary form must reproduce"),
    ("bsd-endorse", r"neither the name of .* may be used to endorse"),
    ("bsd-warranty", r"this software is provided by the copyright holders and contributors as is"),
    ("mpl2", r"mozilla public license,?( version| v)?\.? ?2\.0"),
    ("rights-reserved", r"all rights reserved"),
    ("copyright", r"^(c )?copyright\b.*(19|20)[0-9][0-9]"),
    ("some-license", r"\blicensed under\b|\breleased under\b.*\blicense"),
]
#: (licence, identifiers in order); earlier rules first. Copyright lines may stand between.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("ISC", ["isc-grant", "mit-warranty"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache2", "apache2-may-not", "as-is-apache"]),
    ("Apache-2.0", ["apache2", "apache2-may-not"]),
    ("Apache-2.0", ["apache2"]),
    ("Apache-2.0", ["spdx-apache2"]),
    ("GPL-3.0-or-later", ["gpl3-or-later", "gpl-no-warranty"]),
    ("GPL-3.0-or-later", ["gpl3-or-later"]),
    ("GPL-3.0", ["gpl3", "gpl-no-warranty"]),
    ("GPL-3.0", ["gpl3"]),
    ("GPL-3.0", ["spdx-gpl3"]),
    ("GPL-2.0", ["gpl2", "gpl-no-warranty"]),
    ("GPL-2.0", ["gpl2"]),
    ("AGPL-3.0", ["agpl3"]),
    ("LGPL", ["lgpl"]),
    ("MIT", ["mit", "mit-warranty"]),
    ("MIT", ["mit"]),
    ("MIT", ["spdx-mit"]),
    ("BSD-3-Clause", ["spdx-bsd3"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4"]),
    ("CC-BY-4.0", ["cc-by4"]),
    ("CC0-1.0", ["cc0"]),
    ("MPL-2.0", ["mpl2"]),
]
#: Further patterns of joined sentences: the identifier after which each is tried, and the pattern.
LONGER = {"gpl2": r"gnu general public license.*either version 2"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_pattern(ids: list[str]) -> str:
    """The identifiers in order, with copyright lines between them, in a sequence written `|a|b|c|`."""
    return r"\|(" + r"\|(?:copyright\||rights-reserved\|)*".join(ids) + r")(?=\|)"


#: KEYWORDS whose words may stand on two lines.
_SPREAD = KEYWORDS.replace(" ", "[^a-z0-9]+")


def normal(s: Column) -> Column:
    s = F.regexp_replace(s, "licence", "license")
    s = F.regexp_replace(s, r"[^a-z0-9+.,]+", " ")
    return F.trim(F.regexp_replace(s, r"[.,]+(?![0-9])|(?<![0-9])[.,]+", ""))


def joined(text: Column) -> Column:
    """The sentences of a text that hold a keyword, over line ends, in lower case."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    parts = F.filter(F.split(low, r"\n[ \t\r]*\n|(?<=[.!?])(?<!\bv\.)\s+"), lambda s: s.rlike(_SPREAD))
    return F.when(low.rlike(_SPREAD), parts).otherwise(F.array().cast("array<string>"))


def identifier(sentence: Column, longer: bool = False) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES):
        if longer and name in LONGER:
            out = F.when(sentence.rlike(LONGER[name]), F.lit(name)).otherwise(out)
        out = F.when(sentence.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def identifiers(sentence: Column) -> Column:
    """Of the parts of a joined sentence, and what it matches only as a whole."""
    parts = F.filter(F.split(sentence, r"\n|(?<=[.!?;])[ \t\r]+"), lambda s: s.rlike(KEYWORDS))
    found = F.filter(F.transform(parts, lambda s: identifier(normal(s))), lambda x: x.isNotNull())
    rest = lambda ids, whole: F.filter(ids, lambda x: (x != "some-license") & (whole != "not-licensed") & ~((x == "gpl3") & (whole == "gpl3-or-later")))
    both = lambda ids, whole: F.when(whole.isNull() | F.array_contains(ids, whole), ids).otherwise(F.concat(F.array(whole), rest(ids, whole)))
    return let(found, lambda ids: let(identifier(normal(sentence), longer=True), lambda whole: both(ids, whole)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_sentences, sentence_ids, licenses, left_over."""
    ids = F.flatten(F.transform(joined(F.col(text_col)), identifiers))

    def matched(found: Column) -> Column:
        left = F.concat(F.lit("|"), F.array_join(found, "|"), F.lit("|"))
        for name, sequence in RULES:
            left = F.regexp_replace(left, rule_pattern(sequence), f"|<{name}>")
        return F.filter(F.split(left, r"\|"), lambda x: x != "")

    def out(found: Column) -> Column:
        return let(F.when(F.size(found) > 0, matched(found)).otherwise(F.array().cast("array<string>")), lambda m: F.struct(
            F.size(found).cast("long").alias("n"),
            F.array_join(found, ",").alias("ids"),
            F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(m, lambda x: x.startswith("<")), lambda x: F.regexp_replace(x, "[<>]", "")))), ",").alias("licenses"),
            F.array_join(F.filter(m, lambda x: ~x.startswith("<")), ",").alias("left"),
        ))

    return docs.select(F.col(id_col).alias("doc_id"), let(ids, out).alias("r")).select("doc_id", F.col("r.n").alias("n_sentences"), F.col("r.ids").alias("sentence_ids"), F.col("r.licenses").alias("licenses"), F.col("r.left").alias("left_over"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def case(s: str, longer: bool = False) -> str:
        whens = [(n, p) for name, pattern in SENTENCES for n, p in ((name, pattern), (name, LONGER.get(name) if longer else None)) if p]
        return "case " + " ".join(f"when regexp_matches({s}, '{p}') then '{n}'" for n, p in whens) + " end"

    # RE2 has no lookahead or lookbehind: the closing bar is matched and put back, twice for neighbours, and cuts are marked
    left = "'|' || array_to_string(ids, '||') || '|'"
    for name, sequence in RULES:
        pattern = r"\|(" + r"\|\|(?:copyright\|\||rights-reserved\|\|)*".join(sequence) + r")\|"
        left = f"regexp_replace({left}, '{pattern}', '|<{name}>|', 'g')"
    normal = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({0}, 'licence', 'license'), '[^a-z0-9+.,]+', ' ', 'g'), '[.,]+([^0-9.,]|$)', '\1', 'g'), '(^|[^0-9.,])[.,]+', '\1', 'g'), '[.,]+$', ''))"
    return rf"""
with low as (select doc_id, row_number() over () r, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') t from documents),
cut as (select doc_id, r, regexp_replace(regexp_replace(regexp_replace(t, '\n[ \t\r]*\n', chr(1), 'g'), '\bv\.', 'v' || chr(2), 'g'), '([.!?])[ \t\r\n\f\v]+', '\1' || chr(1), 'g') t from low),
whole as (select doc_id, r, unnest(list_filter(string_split(replace(t, chr(2), '.'), chr(1)), lambda x: regexp_matches(x, '{_SPREAD}'))) s, generate_subscripts(list_filter(string_split(replace(t, chr(2), '.'), chr(1)), lambda x: regexp_matches(x, '{_SPREAD}')), 1) k from cut),
parted as (select doc_id, r, k, {case(normal.format("s"), True)} w,
  list_filter(list_transform(list_filter(string_split(regexp_replace(s, '([.!?;])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)), lambda p: regexp_matches(p, '{KEYWORDS}')), lambda p: {case(normal.format("p"))}), lambda x: x is not null) ids from whole),
marked as (select doc_id, r, k, case when w is null or list_contains(ids, w) then ids else [w] || list_filter(ids, lambda x: x <> 'some-license' and w <> 'not-licensed' and not (x = 'gpl3' and w = 'gpl3-or-later')) end ids from parted),
found as (select l.doc_id, l.r, coalesce(flatten(list(b.ids order by b.k) filter (b.ids is not null)), []::varchar[]) ids from low l left join marked b on l.r = b.r group by l.doc_id, l.r),
matched as (select doc_id, ids, list_filter(string_split({left}, '|'), lambda x: x <> '') m from found)
select doc_id, len(ids)::bigint n_sentences, array_to_string(ids, ',') sentence_ids,
  array_to_string(list_sort(list_distinct(list_transform(list_filter(m, lambda x: starts_with(x, '<')), lambda x: regexp_replace(x, '[<>]', '', 'g')))), ',') licenses,
  array_to_string(list_filter(m, lambda x: not starts_with(x, '<')), ',') left_over
from matched
"""


QUERIES = {"op1_license_scan": op1_license_scan}
SQL = {"op1_license_scan": _sql()}
