"""Screening of untrusted text: hidden instructions, scripts, junk.

A text is looked at as it is, normalised, reversed and with base64 runs decoded.
Python runs in Arrow batches: for compatibility folding of non-ASCII text, and for a first look that reads a text once and
tells which of the exact checks, all built-in expressions, it needs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from presswork.functions.text import once, redact, unescape

MAX_COMMENT, MAX_ARTICLE = 50_000, 200_000

# Invisible characters, look-alikes and digits for letters.
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\ufeff\u00ad\u2060\u2061\u2062\u2063\u2064\u180e"
LOOKALIKES = ("аеорсхуіѕјԁһνοραεικτυΙΟΑЕРСХМТ", "aeopcxyisjdhvopaeiktuIOAEPCXMT")
LEET = ("013457@$", "oieastas")

# The patterns of instructions to a model, in the order in which they are reported; all ignore case.
INJECTION = (
    r"\b(?:ignore|disregard|forget|override|bypass|skip|discard)\s+(?:(?:the\s+)?(?:above|below|previous|prior|preceding|earlier|foregoing|last)\s+(?:instructions?|prompts?|rules?|directions?|guidelines?|commands?|context|system\s+prompt)|(?:all\s+)?(?:previous|prior|earlier|system)?\s*(?:instructions?|prompts?|rules?|directions?|guidelines?|commands?|context|system\s+prompt)|(?:the\s+)?(?:above|below|previous|prior|preceding|earlier|foregoing|last)\s+(?:and|then)\s+(?:classify|label|rate|mark|score|tag|answer|respond|return|act|behave|reply|output|print|reveal|show|repeat))",
    r"(?:^|[\n\r>#*\[\|])\s*(?:system|assistant|user|developer)\s*[:\]]\s*(?:ignore|disregard|show|repeat|output|reveal|print|mark|classify|rate|answer|respond|return|act|behave|override|bypass|skip)",
    r"<\|?\s*im_(?:start|end)\s*\|?>",
    r"\[/?\s*(?:INST|SYS)\s*\]",
    r"\byou\s+(?:are|must|should|will)\s+now\b",
    r"\b(?:new|updated|revised)\s+(?:instructions?|rules?|task|directive)s?\s*:",
    r"\b(?:act|behave|respond|reply|classify|label|rate|mark|score)\s+as\s+if\b",
    r"\b(?:classify|label|rate|mark|score|tag)\s+(?:this|all|every|each)\b.{0,40}\b(?:regardless|no\s+matter|irrespective|whatever)\b",
    r"\b(?:reveal|show|print|repeat|output|dump)\b.{0,20}\b(?:system|initial|original)?\s*prompt\b",
    r"\b(?:developer|god|admin|debug|dan)\s+mode\b",
    r"\bpretend\s+(?:you|to\s+be)\b",
)
#: The pattern whose ^ stands for the start of any line.
BY_LINE = 1
# Fixed value: quoted attack strings in coverage of such attacks exempt the view that has them.
REPORTED = r'"[^"]*(?:system|assistant|user|developer)\s*:\s*(?:ignore|disregard|show|repeat|output|reveal|print|mark|classify|rate|answer|respond|return|act|behave)[^"]*".*(?:style attack|article|research|study|report|example)'
HIDDEN = "[\u200b-\u200f\ufeff\u00ad\u2060-\u2064]"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalised(text: Column) -> Column:
    """Folded for matching only: compatibility forms, invisibles, look-alikes, case, leet, separators inside words, white space."""
    ascii_only = text.rlike(r"^\p{ASCII}*$")
    # Python is called for every row, whatever stands around it: ASCII texts are held back in its argument.
    return _folded(F.when(ascii_only, text).otherwise(_plain_letters(_nfkc(F.when(~ascii_only, text)))))


def _plain_letters(text: Column) -> Column:
    return F.translate(F.translate(text, INVISIBLE, ""), *LOOKALIKES)


def _folded(text: Column) -> Column:
    out = F.lower(text)
    out = F.regexp_replace(F.translate(out, *LEET), r"(?<=[a-z])[._\-*|/]+(?=[a-z])", "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def decoded_views(text: Column) -> Column:
    """Plain texts in base64 runs of 16 characters or more: valid UTF-8, 8 characters or more, over 90 % printable."""
    runs = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9+/]{16,}={0,2})"), F.lit(1))
    padded = F.transform(runs, lambda r: F.concat(r, F.repeat(F.lit("="), F.pmod(-F.length(r), F.lit(4)))))
    raw = F.filter(F.transform(padded, lambda p: F.try_to_binary(p, F.lit("base64"))), lambda b: b.isNotNull())
    texts = F.transform(F.filter(raw, lambda b: F.is_valid_utf8(b.cast("string"))), lambda b: b.cast("string"))
    return F.filter(texts, lambda t: (F.length(t) >= 8) & (F.length(F.regexp_replace(t, r"(?U)[^\p{Print}\s]", "")) > 0.9 * F.length(t)))


#: What a text must hold for each pattern to match at all: some word of every group. The group that rules out most stands first.
REQUIRED = (
    (("ignore", "disregard", "forget", "override", "bypass", "skip", "discard"), ("instruction", "prompt", "rule", "direction", "guideline", "command", "context", "and", "then")),
    (("system", "assistant", "user", "developer"), (":", "]")),
    (("im_",), ("<",)),
    (("[",), ("inst", "sys")),
    (("now",), ("you",)),
    ((":",), ("instruction", "rule", "task", "directive"), ("new", "updated", "revised")),
    (("if",), ("act", "behave", "respond", "reply", "classify", "label", "rate", "mark", "score")),
    (("regardless", "matter", "irrespective", "whatever"), ("classify", "label", "rate", "mark", "score", "tag")),
    (("prompt",), ("reveal", "show", "print", "repeat", "output", "dump")),
    (("mode",), ("developer", "god", "admin", "debug", "dan")),
    (("pretend",),),
)


def _plain_case(text: Column) -> Column:
    """Lower case; the four other letters that match a Latin one when case is ignored become that one."""
    for odd, plain in zip("\u017f\u0131\u0130\u212a", "siik", strict=True):
        text = F.replace(text, F.lit(odd), F.lit(plain))
    return F.lower(text)


def _may_match(low: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    every = F.lit(True)
    for words in groups:
        some = F.lit(False)
        for w in words:
            some = some | low.contains(w)
        every = every & some
    return every


def _first_hit(view: Column, low: Column, name: Column) -> Column:
    """Which pattern a view matches first; NULL for none or for reported speech. ``low`` is the view in plain case.

    A pattern is only tried on texts that hold its required words, which are looked for as plain substrings.
    """
    hits = [
        F.when(_may_match(low, REQUIRED[i]) & view.rlike(("(?ium)" if i == BY_LINE else "(?iu)") + p), F.concat(F.lit("injection_pattern["), name, F.lit(f"]:{p[:48]}")))
        for i, p in enumerate(INJECTION)
    ]
    found = F.coalesce(*hits)
    return F.when(found.isNotNull(), F.when(~view.rlike("(?iu)" + REPORTED), found))


def _spread(*words: str) -> str:
    """One of the words, also with separators between its letters."""
    return "(?:" + "|".join(r"[._*|/-]*".join(w) for w in words) + ")"


_GAP = r"[\s\x0b]"
#: What a lower-case text without digits for letters must hold for any pattern to match it, as it is or with separators taken out of words; word borders play no part.
OPENINGS = "|".join((
    _spread("ignore", "disregard", "forget", "override", "bypass", "skip", "discard") + _GAP,
    _spread("system", "assistant", "user", "developer") + rf"{_GAP}*[:\]]",
    rf"<\|?{_GAP}*" + _spread("im"),
    rf"\[/?{_GAP}*" + _spread("inst", "sys"),
    _spread("you") + f"{_GAP}+" + _spread("are", "must", "should", "will") + f"{_GAP}+" + _spread("now"),
    _spread("new", "updated", "revised") + f"{_GAP}+" + _spread("instruction", "rule", "task", "directive"),
    _spread("act", "behave", "respond", "reply", "classify", "label", "rate", "mark", "score") + f"{_GAP}+" + _spread("as") + f"{_GAP}+" + _spread("if"),
    _spread("classify", "label", "rate", "mark", "score", "tag") + f"{_GAP}+" + _spread("this", "all", "every", "each"),
    _spread("prompt"),
    _spread("developer", "god", "admin", "debug", "dan") + f"{_GAP}+" + _spread("mode"),
    _spread("pretend") + _GAP,
))
#: Characters other than ASCII and the Latin letters, signs, dashes and quotes that stand for themselves in every view, and for no other letter when case is ignored.
ODD = "[^\x01-\x7f\xa1-\xa7\xa9\xab\xac\xae\xb0\xb1\xb6\xb7\xbb\xbf-\u012f\u0134-\u013e\u0141-\u0148\u014a-\u017e\u2010\u2012-\u2015\u2018-\u201e\u2020-\u2022\u2039\u203a\u20ac]"
RUN = "[A-Za-z0-9+/]{16}"
SCRIPT = "(?i)(?:<|&lt;)script"


LOOK = StructType([StructField(name, BooleanType()) for name in ("opens", "hides", "runs", "script")] + [StructField("compatible", StringType())])
#: What odd characters become before beginnings are looked for: look-alikes, letters that match a Latin one when case is ignored, white space that compatibility forms leave.
_ALIKE = str.maketrans(LOOKALIKES[0] + "\u017f\u0131\u0130\u212a\x85\u1680\u2028\u2029", LOOKALIKES[1] + "siik" + " " * 4, INVISIBLE)


@F.arrow_udf(LOOK)
def _look(text: pa.Array) -> pa.Array:
    """Which exact checks a text needs, in one reading: none of these is false where the check would find something.

    opens: it, its normal form or the reverse of that may match a pattern; hides: it has invisible characters; runs: it
    may hide base64; script: a script tag may open. ``compatible`` is the compatibility form of a text with odd characters.
    """
    odd = [t.as_py() if o.is_valid and o.as_py() else None for t, o in zip(text, pc.match_substring_regex(text, ODD), strict=True)]
    compatible = [None if t is None else unicodedata.normalize("NFKC", t) for t in odd]
    both = [None if t is None else f"{t}\n{c}".translate(_ALIKE) for t, c in zip(odd, compatible, strict=True)]
    low = pc.ascii_lower(pc.coalesce(pa.array(both, text.type), text))
    for digit, letter in zip(*LEET, strict=True):
        low = pc.replace_substring(low, digit, letter)
    opens = pc.or_(pc.match_substring_regex(low, OPENINGS), pc.match_substring_regex(pc.utf8_reverse(low), OPENINGS))
    marks = [opens, *(pc.match_substring_regex(text, p) for p in (HIDDEN, RUN, SCRIPT)), pa.array(compatible, pa.string())]
    return pa.StructArray.from_arrays(marks, LOOK.fieldNames())


def injection(text: Column) -> Column:
    """Why a text looks like an instruction to a model (view and pattern); NULL if it does not."""
    t = F.coalesce(text, F.lit(""))
    return once(F.struct(t.alias("text"), _look(t).alias("look")), lambda x: _injected(x["text"], x["look"]))


def _injected(t: Column, look: Column) -> Column:
    """``injection`` of a text that was looked at (Python cannot be called inside ``once``); what the look ruled out is not tried.

    Views are elements of an array, so that each is made once for all patterns.
    """

    def view(name: str, of: Column, low: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), of.alias("text"), low.alias("low"))

    def views(flat: Column) -> Column:
        low = F.replace(flat, F.lit("\u0131"), F.lit("i"))  # the only one of these letters that folding leaves
        return F.array(view("raw", t, _plain_case(t)), view("normalized", flat, low), view("reversed", F.reverse(flat), F.reverse(low)))

    def found(all_views: Column) -> Column:
        hits = F.filter(F.transform(all_views, lambda v: _first_hit(v["text"], v["low"], v["name"])), lambda h: h.isNotNull())
        return F.get(hits, F.lit(0))

    flat = _folded(F.coalesce(_plain_letters(look["compatible"]), t))
    hidden = F.transform(F.transform(decoded_views(t), lambda v: _folded(_plain_letters(v))), lambda v: view("base64", v, _plain_case(v)))
    inside = F.when(t.rlike(rf"(?U)\w{HIDDEN}\w"), F.lit("injection_pattern[obfuscation]:zero_width_inside_word"))
    return F.coalesce(F.when(look["opens"], found(once(flat, views))), F.when(look["runs"], found(hidden)), F.when(look["hides"], inside))


def _screened(text: Column, longest: int, use: Callable[[Column], Column]) -> Column:
    """``use`` of struct(reason, detail, text): the checks in order, the first failure decides.

    The costly search runs once, and only for texts that the checks before it let through.
    """

    def first(t: Column, look: Column) -> Column:
        blank = ~F.coalesce(t, F.lit("")).rlike(r"(?U)\S")
        script = F.when(look["script"], unescape(t).rlike(r"(?i)<script\b"))
        return F.when(blank, "empty_or_invalid_type").when(F.length(t) > longest, "exceeds_max_length").when(script, "html_script_detected")

    def searched(x: Column) -> Column:
        detail = F.when(x["first"].isNull(), _injected(x["text"], x["look"]))
        return F.struct(x["first"].alias("first"), detail.alias("detail"), x["text"].alias("text"))

    def told(x: Column) -> Column:
        reason = F.coalesce(x["first"], F.when(x["detail"].isNotNull(), "prompt_injection_suspected"))
        return F.struct(reason.alias("reason"), x["detail"].alias("detail"), x["text"].alias("text"))

    looked = F.struct(text.alias("text"), _look(text).alias("look"))
    checked = once(looked, lambda x: F.struct(first(x["text"], x["look"]).alias("first"), x["text"].alias("text"), x["look"].alias("look")))
    return once(once(once(checked, searched), told), use)


def verdict(text: Column, longest: int = MAX_COMMENT) -> Column:
    """struct(passed, reason, flagged_detail, clean_text): the checks in order, the first failure decides."""

    def told(x: Column) -> Column:
        reason = x["reason"]
        flagged = F.when(reason == "html_script_detected", "<script").otherwise(x["detail"])
        return F.struct(reason.isNull().alias("passed"), reason.alias("reason"), flagged.alias("flagged_detail"), F.when(reason.isNull(), redact(x["text"])).alias("clean_text"))

    return _screened(text, longest, told)


def reason(text: Column, longest: int = MAX_COMMENT) -> Column:
    """The reason of ``verdict`` alone, where nobody reads the clean text: it is not made."""
    return _screened(text, longest, lambda x: x["reason"])


def totals(screened: DataFrame, reason: str = "verdict.reason") -> DataFrame:
    """Rows by reason ('passed' for none), each with the numbers of all ``screened`` and all ``quarantined`` rows.

    The verdicts are reduced to one row for each reason first.
    """
    counts = screened.groupBy(F.coalesce(reason, F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))
    every = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("screened"), F.coalesce(F.sum(F.when(F.col("reason") != "passed", F.col("n"))), F.lit(0)).alias("quarantined"))
    return counts.crossJoin(F.broadcast(every))  # one row


def article_text(title: str | Column, body: str | Column) -> Column:
    """What is screened of an article: title, blank line and body."""
    t, b = (F.col(x) if isinstance(x, str) else x for x in (title, body))
    return F.concat(F.coalesce(t, F.lit("")), F.lit("\n\n"), F.coalesce(b, F.lit("")))


def junk(text: Column) -> Column:
    """empty, deleted_removed, mod_removed, bot_boilerplate or too_short, the first that holds; NULL for none."""
    t = F.coalesce(text, F.lit(""))
    trimmed = F.regexp_replace(t, r"^\s+|\s+$", "")
    return (
        F.when(t == "", "empty").when(trimmed.isin("[deleted]", "[removed]"), "deleted_removed")
        .when(t.rlike("(?i)removed by (?:reddit|moderator)|this comment was removed"), "mod_removed")
        .when(t.rlike("(?i)i am a bot|performed automatically|contact the moderators"), "bot_boilerplate").when(F.length(trimmed) < 15, "too_short")
    )
