"""What a rewriter's or a judge's reply says, and whether it may be used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx

#: Limits of an accepted reply, in words.
MOST, MORE, MOST_CLARIFY = 80, 40, 60
#: Words that may begin a question or a command in capitals.
STARTERS = (
    "how what why which who whom when where does do did is are was were can could should would will "
    "compare contrast explain describe tell give list show summarize define and but or also then in "
    "on for with between versus using the a an so if since while"
).split()
TAGS = "STANDALONE|REWRITE|CLARIFY|NEW_TOPIC"
#: What counts as quoted; what a reply's line looks like.
_QUOTED = "\"([^\"]+)\"|“([^”]+)”"
_REPLY = r"(?i)^\s*({tags})\b\s*:?\s*(.*?)\s*$"
#: A capitalised word with what stands before it: the beginning, a sentence's end and a space, or anything else.
_NAMED = r"(?:^\s*|[.!?]\s+|.)\b([A-Z][A-Za-z0-9]*)\b"


def reply_parts(reply: Column) -> Column:
    """struct(tag, payload) of the first line that isn't blank: a known tag and its text; `empty` for no line or a tag without
    its text (STANDALONE needs none); `unparsed` for anything else. Null is empty."""
    lines = F.filter(F.split(F.coalesce(reply, F.lit("")), r"\r\n|[\n\r]"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    pattern = _REPLY.format(tags=TAGS)
    tag = F.upper(F.regexp_extract(first, pattern, 1))
    payload = F.regexp_replace(F.regexp_extract(first, pattern, 2), "^[`\"' ]+|[`\"' ]+$", "")
    kind = F.when(first == "", "empty").when(tag == "", "unparsed").when(tag == "STANDALONE", tag).when(payload == "", "empty").otherwise(tag)
    return F.struct(kind.alias("tag"), F.when(kind.isin("REWRITE", "CLARIFY", "NEW_TOPIC"), payload).otherwise("").alias("payload"))


def _quotes(text: Column) -> Column:
    both = F.concat(*(F.regexp_extract_all(text, F.lit(_QUOTED), F.lit(i)) for i in (1, 2)))
    plain = F.transform(F.filter(both, lambda q: q != ""), lambda q: F.trim(F.regexp_replace(F.lower(q), r"[\x20\x09-\x0D]+", " ")))
    return F.array_distinct(plain)


def invented_names(text: Column, known: Column) -> Column:
    """Capitalised words of a text, lower-cased, that aren't among known words; "I", and a question or command word that begins
    a sentence, don't count."""
    seen = F.transform(F.regexp_extract_all(text, F.lit(rf"(?s){_NAMED}"), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, r"([A-Z][A-Za-z0-9]*)$", 1).alias("w"), m.rlike(r"(?s)^(?:\s*|[.!?]\s+)[A-Z]").alias("first")))
    counted = F.filter(seen, lambda x: (x["w"] != "I") & ~(x["first"] & F.lower(x["w"]).isin(STARTERS)))
    return F.array_except(F.transform(counted, lambda x: F.lower(x["w"])), known)


def rejection(kind: Column, text: Column, message: Column, shown: Column) -> Column:
    """Why a rewritten or clarifying text (kind `rewrite` or `clarify`) may not be used, null if it may; the first that holds:

    too_long; flagged (by the scan, or the output filter without context); for rewrites dropped_constraint (a number, a
    quoted string or a limiting word of the message is missing); invented_detail (a number or a name that neither the message
    nor what the rewriter was shown has). Null texts are empty.
    """
    text, message, shown = (F.coalesce(c, F.lit("")) for c in (text, message, shown))
    rewrite, n = kind == "rewrite", tx.word_count(text)
    long = (n > F.when(rewrite, MOST).otherwise(MOST_CLARIFY)) | (rewrite & (n > tx.word_count(message) + MORE))
    flagged = (F.size(tx.scan(text)) > 0) | (F.size(tx.filter_reasons(text, F.lit(""), [])) > 0)
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "n['’]t\\b", " not"), r"[\x20\x09-\x0D]+", " ")
    gone = lambda f: F.size(F.array_except(f(message), f(text))) > 0
    dropped = gone(tx.numbers) | F.exists(_quotes(message), lambda q: ~F.contains(plain, q)) | gone(tx.constraints)
    context = F.concat(shown, F.lit(" "), message)
    new_numbers = F.size(F.array_except(tx.numbers(text), tx.numbers(context))) > 0
    names = F.size(invented_names(text, tx.tokens(context, drop_stopwords=False))) > 0
    return F.when(long, "too_long").when(flagged, "flagged").when(rewrite & dropped, "dropped_constraint").when(new_numbers | names, "invented_detail")


def first_object(reply: Column) -> Column:
    """The JSON object in a model's reply as text, between its first and its last brace, code fences aside; null if there is none
    that parses. Read fields of it with get_json_object."""
    bare = F.regexp_replace(reply, "```(?:json)?", "")
    found = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found)


def document_citations(text: Column) -> Column:
    """Documents that a text cites as D1, in a bracket or without, distinct in the order of appearance; null for a number too
    large."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\bD(\d+)\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: n.try_cast("long")))
