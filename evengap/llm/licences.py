"""Licence recognition by sentence rules: known sentences get identifiers, and ordered rules match their sequence.

Everything is one projection of a row in Spark's own functions; texts without any word that a known sentence has are
passed by. A line break inside a sentence is a space; lines that end without a full stop are read by themselves as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Single words, one of which every known sentence has, however it is wrapped.
HINT = r"(?i)licen[sc]|released|distributed|available|published|provided|domain|reserved|permission|redistribut|endorse"
#: Identifiers of sentences, and what the normalised sentence looks like.
THIS = r"(?:(?:this|the) (?:work|software|file|project|code|program|library|material|document|text|content|article|page) is )?"
UNDER = THIS + r"(?:licensed|released|distributed|available|published|provided)(?: to you)? under (?:the )?(?:terms of )?(?:the )?"
SENTENCES = [
    ("mit-ref", UNDER + r"mit(?: x11)? licen[sc]e$"),
    ("apache2-ref", UNDER + r"apache(?: software)? licen[sc]e (?:version |v)?2(?:\.0)?(?: the license)?$"),
    ("gpl2-ref", UNDER + r"gnu (?:general public licen[sc]e|gpl) (?:version |v)?2(?:\.0)?$"),
    ("gpl3-ref", UNDER + r"gnu (?:general public licen[sc]e|gpl) (?:version |v)?3(?:\.0)?$"),
    ("gpl-any", r"either version (?:2|3) of the license or at your option any later version$"),
    ("lgpl-ref", UNDER + r"gnu (?:lesser general public licen[sc]e|lgpl) (?:version |v)?(?:2\.1|3)(?:\.0)?$"),
    ("agpl3-ref", UNDER + r"gnu (?:affero general public licen[sc]e|agpl) (?:version |v)?3(?:\.0)?$"),
    ("mpl2-ref", UNDER + r"mozilla public licen[sc]e (?:version |v)?2(?:\.0)?$"),
    ("bsd-ref", UNDER + r"(?:new |modified |3 clause |2 clause |simplified )?bsd licen[sc]e$"),
    ("cc-by-nc-sa-ref", UNDER + r"(?:creative commons |cc )(?:by|attribution) (?:nc|noncommercial) (?:sa|sharealike)(?: [1-4]\.0)?(?: international)?(?: licen[sc]e)?$"),
    ("cc-by-nc-ref", UNDER + r"(?:creative commons |cc )(?:by|attribution) (?:nc|noncommercial)(?: [1-4]\.0)?(?: international)?(?: licen[sc]e)?$"),
    ("cc-by-sa-ref", UNDER + r"(?:creative commons |cc )(?:by|attribution) (?:sa|sharealike)(?: [1-4]\.0)?(?: international)?(?: licen[sc]e)?$"),
    ("cc-by-ref", UNDER + r"(?:creative commons |cc )(?:by|attribution)(?: [1-4]\.0)?(?: international)?(?: licen[sc]e)?$"),
    ("cc0-ref", r"(?:" + UNDER + r"cc0(?: 1\.0)?|" + THIS + r"(?:released |placed |dedicated )?(?:in|into|to) the public domain)(?: licen[sc]e)?$"),
    ("reserved", r"(?:copyright [a-z0-9 .-]{0,80})?all rights reserved$"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software\b"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies\b"),
    ("as-is", r"(?:the|this) software is provided (?:by the copyright holders and contributors )?as is\b"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted\b"),
    ("bsd-source", r"(?:[0-9]\.? )?redistributions of source code must retain the above copyright notice\b"),
    ("bsd-binary", r"(?:[0-9]\.? )?redistributions in binary form must reproduce the above copyright notice\b"),
    ("bsd-endorse", r"(?:[0-9]\.? )?neither the name of [a-z0-9 .-]{0,120} may be used to endorse or promote products\b"),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted\b"),
]
#: Licences and the sequence of identifiers that shows each; earlier rules take their sentences first.
RULES = [
    ("MIT", "mit-grant mit-notice as-is"), ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-endorse as-is"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary as-is"), ("ISC", "isc-grant as-is"),
    ("GPL-2.0-or-later", "gpl2-ref gpl-any"), ("GPL-3.0-or-later", "gpl3-ref gpl-any"),
    ("MIT", "mit-ref"), ("Apache-2.0", "apache2-ref"), ("GPL-2.0", "gpl2-ref"), ("GPL-3.0", "gpl3-ref"),
    ("LGPL", "lgpl-ref"), ("AGPL-3.0", "agpl3-ref"), ("MPL-2.0", "mpl2-ref"), ("BSD", "bsd-ref"),
    ("CC-BY-NC-SA", "cc-by-nc-sa-ref"), ("CC-BY-NC", "cc-by-nc-ref"), ("CC-BY-SA", "cc-by-sa-ref"), ("CC-BY", "cc-by-ref"),
    ("public-domain", "cc0-ref"), ("all-rights-reserved", "reserved"), ("unknown", "unknown"),
]
#: A sentence that speaks of a licence in a known way, but of none that is known.
UNKNOWN = r"\b(?:licensed|released|distributed) under\b"
ENDS, NOISE = r"([.;:!?])\s+", "[^a-z0-9.]+"


def identifiers(text: Column) -> Column:
    """Identifiers of a text's known sentences, in order, each between single spaces."""
    mark = "\x01"
    ended = F.regexp_replace(F.regexp_replace(F.translate(text, mark, " "), ENDS, "$1" + mark), r"\n[ \t\r]*\n", mark)
    some = F.filter(F.split(ended, mark), lambda s: s.rlike(HINT))

    def plain(s: Column) -> Column:
        return F.rtrim(F.ltrim(F.regexp_replace(F.lower(s), NOISE, " ")), F.lit(". "))

    def known(s: Column) -> Column:
        chosen = F.when(s.rlike("^" + SENTENCES[0][1]), SENTENCES[0][0])
        for name, pattern in SENTENCES[1:]:
            chosen = chosen.when(s.rlike("^" + pattern), name)
        return chosen.when(s.rlike(UNKNOWN), "unknown").otherwise("")

    # lines that are known by themselves stand; else the sentence is read across its line breaks
    read = F.transform(some, lambda s: F.struct(F.transform(F.transform(F.split(s, "\n"), plain), known).alias("lines"),
                                                F.transform(F.array(plain(s)), known)[0].alias("whole")))
    chosen = F.flatten(F.transform(read, lambda r: F.when(
        F.exists(r["lines"], lambda x: ~x.isin("", "unknown")) | (r["whole"] == ""), r["lines"]).otherwise(F.array(r["whole"]))))
    return F.concat(F.lit(" "), F.array_join(F.transform(F.filter(chosen, lambda x: x != ""), lambda x: F.concat(x, F.lit(" "))), " "))


def scan(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sentences, licences) of every row: identifiers in order of the text, licences in order of the rules.

    Both are joined by one space; a null or empty text, or one without a known sentence, gives empty strings. Rows are
    scanned by themselves: null or repeated ids and repeated rows stay, other columns are ignored, and an empty table
    gives none. A licence is named once; a rule's sentences are taken, so that later rules don't see them.
    """
    found = F.when(F.col(text).rlike(HINT), identifiers(F.col(text))).otherwise(F.lit(" "))
    out = docs.select(F.col(id).alias("doc_id"), found.alias("seq")).withColumn("sentences", F.trim(F.regexp_replace("seq", " +", " ")))
    out = out.withColumn("seq", F.concat(F.lit(" "), F.regexp_replace("sentences", " ", "  "), F.lit(" ")))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f" {sequence.replace(' ', '  ')} ").alias("what")) for name, sequence in RULES])

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["seq"], rule["what"])
        return F.struct(F.replace(state["seq"], rule["what"], F.lit("")).alias("seq"),
                        F.when(hit, F.array_union(state["names"], F.array(rule["name"]))).otherwise(state["names"]).alias("names"))

    start = F.struct(F.col("seq").alias("seq"), F.array().cast("array<string>").alias("names"))
    names = F.when(F.col("sentences") == "", F.lit("")).otherwise(F.array_join(F.aggregate(rules, start, step)["names"], " "))
    return out.select("doc_id", "sentences", names.alias("licences"))


def _sql() -> str:
    chosen = "CASE " + " ".join(f"WHEN regexp_matches(s, '^{p}') THEN '{n}'" for n, p in SENTENCES)
    chosen += f" WHEN regexp_matches(s, '{UNKNOWN}') THEN 'unknown' ELSE '' END"
    steps = []
    for i, (name, what) in enumerate(RULES):
        spaced = f" {what.replace(' ', '  ')} "
        steps.append(f"r{i} AS (SELECT doc_id, sentences, replace(seq, '{spaced}', '') AS seq, CASE WHEN contains(seq, '{spaced}') "
                     f"AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names "
                     f"FROM {f'r{i - 1}' if i else 'b'})")
    mark, line = "chr(1)", "chr(10)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
p AS (SELECT r, generate_subscripts(x, 1) AS i, unnest(x) AS t FROM (SELECT r, string_split(regexp_replace(regexp_replace(
    replace(text, {mark}, ' '), '([.;:!?])[ \\t\\n\\v\\f\\r]+', '\\1' || {mark}, 'g'), '\\n[ \\t\\r]*\\n', {mark}, 'g'), {mark}) AS x FROM d)),
l AS (SELECT r, i, 0 AS j, t FROM p UNION ALL
      SELECT r, i, generate_subscripts(y, 1) AS j, unnest(y) AS t FROM (SELECT r, i, string_split(t, {line}) AS y FROM p)),
n AS (SELECT r, i, j, rtrim(trim(regexp_replace(lower(t), '{NOISE}', ' ', 'g')), '. ') AS s FROM l),
v AS (SELECT r, i, j, {chosen} AS id FROM n),
u AS (SELECT r, i, bool_or(j > 0 AND id NOT IN ('', 'unknown')) OR bool_or(j = 0 AND id = '') AS by_line FROM v GROUP BY r, i),
k AS (SELECT r, i * 1000000000 + j AS i, id FROM v JOIN u USING (r, i) WHERE by_line = (j > 0)),
g AS (SELECT r, string_agg(id, ' ' ORDER BY i) AS sentences FROM k WHERE id <> '' GROUP BY r),
b AS (SELECT doc_id, coalesce(sentences, '') AS sentences, ' ' || replace(coalesce(sentences, ''), ' ', '  ') || ' ' AS seq, []::VARCHAR[] AS names
      FROM d LEFT JOIN g USING (r)),
{', '.join(steps)}
SELECT doc_id, sentences, coalesce(array_to_string(names, ' '), '') AS licences FROM r{len(RULES) - 1}
"""


SQL = _sql()
