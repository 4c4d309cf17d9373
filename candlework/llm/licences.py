"""Licence scans by canonical digest.

A text is brought to canonical form (letter case, title, copyright and rights lines, equivalent spellings, punctuation and white space) and
digested; the digest of the whole text is joined to the digests of known licences. The same is done with each of its
lines against known one-line notices. All of it is SQL functions on the row: no shuffle. The known digests are a fixed
table of this module or of the caller, whose size is checked before it is sent to the executors.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlework.llm.licence_texts import LICENCES, LONG_LICENCES, MORE_NOTICES, NOTICES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Equivalent spellings, each side a word or words in canonical form.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber",
    "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center", "copyright owner": "copyright holder", "emphasised": "emphasized",
    "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "licences": "licenses", "licenced": "licensed", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "non commercial": "noncommercial", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "per cent": "percent", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "sub license": "sublicense", "sub licence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "http": "https",
}
_MARK = r"[ \t\r#*=/;>-]*+"
#: Lines that a licence's header may have: a title, a copyright statement, the rights line.
_TITLE = r"(?:the )?(?:mit|isc|expat|zlib|boost software|(?:simplified |revised |modified |new |zero[- ]clause |[23][- ]clause )*bsd(?:[- ](?:zero|[023])(?:[- ]clause)?)?)(?: no attribution)?(?: \"[a-z]+\"(?: or \"[a-z]+\")*)? licen[cs]e(?: \([a-z0-9 -]+\)| - version 1\.0(?: - [a-z0-9 ,]+)?)?[.:]?"
_HOLDER = r"(?:copyright(?![ \t]+(?:notice|holder|owner|licen|law|and|or|the|in|on|is|of)s?\b)\b|\(c\)|©)[^\n]*"
_RIGHTS = r"all rights reserved\.?"
_HEADER = rf"\A(?:\s*+{_MARK}(?:{_TITLE}|{_HOLDER}|{_RIGHTS}){_MARK}(?=\n|\z)){{1,200}}(?=[\x00-\x2F\x3A-\x60\x7B-\x7F]*+[^\x00-\x2F\x3A-\x60\x7B-\x7F])"
#: A copyright statement or the rights line anywhere; a wrapped line that only begins with the word is none.
_STATEMENT = rf"(^|\n){_MARK}(?:(?:copyright[ \t:,]*(?:\(c\)|©|[0-9]{{4}}|[<\[{{{{]?(?:year|yyyy)\b)|\(c\)[ \t]*[0-9]{{4}}|©)[^\n]*|{_RIGHTS}{_MARK}(?=\n|\z))"
#: Largest table of known digests that is sent to every executor, and most notices.
MOST_KNOWN = 10_000


def spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def canonical(text: Column) -> Column:
    """Canonical form of a text; equal forms are equal licences."""
    t = F.translate(text, _UPPER, _LOWER)
    t = F.regexp_replace(t, F.lit(_HEADER), F.lit("\n"))
    t = F.regexp_replace(t, F.lit(_STATEMENT), F.lit("\n"))
    t = F.regexp_replace(t, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+|[‐-―‘-‟©®]+", " ")
    t = F.concat(F.lit(" "), F.replace(F.trim(t), F.lit(" "), F.lit("  ")), F.lit(" "))  # each word with its own blanks
    t = reduce(lambda x, pair: F.replace(x, F.lit(spaced(pair[0])), F.lit(spaced(pair[1]))), SPELLINGS.items(), t)
    return F.regexp_replace(F.trim(t), " +", " ")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark, texts: list[tuple[str, str]]) -> DataFrame:
    """(licence_id, licence_digest) of (id, text); of texts alike in canonical form, the first id."""
    rows = spark.createDataFrame(texts, "licence_id string, t string")
    return rows.groupBy(digest(F.col("t")).alias("licence_digest")).agg(F.min("licence_id").alias("licence_id"))


def _telling(texts: list[str]) -> list[str] | None:
    """A word of each text that no spelling rule changes; None if a text has none."""
    changed = {w for pair in SPELLINGS.items() for side in pair for w in side.split()}
    out = set()
    for t in texts:
        words = [w for w in re.findall("[a-z0-9]+", t.lower()) if w not in changed]
        if not words:
            return None
        out.add(max(words, key=lambda w: (len(w), w)))
    return sorted(out)


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", licences: dict[str, str] | DataFrame | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """Per row: doc_id, text_digest, licence_id (of the whole text, or null), notice_ids (of its lines, sorted), n_notices.

    Licences are the known texts by their ids: those of this package, a dictionary, or a table (licence_id, text) of any
    size, whose digests Spark joins by shuffling both sides if they are many. Notices are MOST_KNOWN at most.
    A null text has a null digest and no notices; a text without letters or digits has no licence. Ids may be null or
    repeat: every row has its result.
    """
    spark = docs.sparkSession
    notices = [*NOTICES.items(), *MORE_NOTICES] if notices is None else list(notices.items())
    if len(notices) > MOST_KNOWN:
        raise ValueError(f"at most {MOST_KNOWN} notices can be sent to every executor")
    if isinstance(licences, DataFrame):
        texts = licences.select("licence_id", F.col("text").alias("t"))
        whole = texts.groupBy(digest(F.col("t")).alias("licence_digest")).agg(F.min("licence_id").alias("licence_id"))
    else:
        listed = [*LICENCES.items(), *LONG_LICENCES.items()] if licences is None else list(licences.items())
        whole = known(spark, listed)
        whole = F.broadcast(whole) if len(listed) <= MOST_KNOWN else whole
    lines = {r.licence_digest: r.licence_id for r in known(spark, notices).collect()} if notices else {}
    by_line = F.create_map(*[F.lit(x) for pair in lines.items() for x in pair]) if lines else F.create_map().cast("map<string,string>")
    t = F.col(text).cast("string")
    # A line without one of the notices' telling words can't be one: only the others are brought to canonical form.
    words = _telling([text for _, text in notices])
    likely = F.split(t, "\n") if words is None else F.filter(F.split(t, "\n"), lambda x: F.translate(x, _UPPER, _LOWER).rlike("|".join(words) or "(?!)"))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(likely, lambda x: F.try_element_at(by_line, digest(x))), lambda x: x.isNotNull())))
    one = docs.select(F.col(doc_id), F.nullif(digest(t), F.sha2(F.lit(""), 256)).alias("text_digest"), F.coalesce(found, F.array().cast("array<string>")).alias("notice_ids"))
    out = one.join(whole, F.col("text_digest") == F.col("licence_digest"), "left")
    return out.select(doc_id, "text_digest", "licence_id", F.array_join("notice_ids", ",").alias("notice_ids"), F.size("notice_ids").cast("long").alias("n_notices"))
