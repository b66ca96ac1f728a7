"""Page and article text as column expressions: markup to text, fragments removed to a fixpoint, sentences and narrative sentences.

Blank is what Unicode calls white space, and the four separators before the space. Nulls are empty texts.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions.text import held

BLANKS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
NO_SPACE = BLANKS[:-1].replace(r"\x1C-\x20", r"\x1C-\x1F")
REFERENCE = "&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]{0,31};?"
#: Names that count without a semicolon, the longest first, since one may open another.
UNCLOSED = "^&(?:%s)" % "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
REPLACED = "�"


def references() -> dict[str, str]:
    """What references stand for: names from the HTML 5 table, the common ones first, and numbers that pages use for Windows characters."""
    common = [f"{n};" for n in ("amp", "quot", "lt", "gt", "nbsp", "apos", "rsquo", "lsquo", "rdquo", "ldquo", "ndash", "mdash", "hellip")]
    windows = {f"#{b}": bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)}
    return {f"&{n}": html5[n] for n in dict.fromkeys([*common, *sorted(html5)])} | windows


def running(values: Column, start: Column, step: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """The states after each of the values. States are gathered in blocks, so that the work grows with the values and not with their square."""

    def inside(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(block)), lambda i: F.slice(v, i + 1, block))
        return held(blocks, lambda b: F.flatten(F.zip_with(b, F.slice(opening(b), 1, F.size(b)), gathered)))

    def opening(blocks: Column) -> Column:
        return F.aggregate(blocks, F.array(start), lambda found, b: F.concat(found, F.array(F.aggregate(b, F.element_at(found, -1), step))))

    def gathered(values: Column, state: Column) -> Column:
        return F.slice(F.aggregate(values, F.array(state), lambda found, x: F.concat(found, F.array(step(F.element_at(found, -1), x)))), 2, block)

    return held(values, inside)


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?=[^!-~])(?: {BLANKS}|{NO_SPACE}{BLANKS[:-1]}*)", " "))  # single spaces may stay; printable ASCII is passed over first


def _numbered(reference: Column, table: Column) -> Column:
    hexadecimal = F.rlike(reference, F.lit("^&#[xX]"))
    digits = F.regexp_replace(F.regexp_replace(reference, "^&#[xX]?0*", ""), ";$", "")
    number = F.when(F.length(digits) > 7, F.lit("16777216")).when(digits == "", F.lit("0")).when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).cast("int")

    def character(n: Column) -> Column:
        mute = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        bad = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        coded = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(n.between(128, 159), F.element_at(table, F.concat(F.lit("#"), n.cast("string")))).when(bad, F.lit(REPLACED)).when(mute, F.lit("")).when(n == 0xFEFF, F.lit("﻿")).otherwise(coded)

    return held(number, character)


def unescaped(text: Column) -> Column:
    """A text with its references as characters: numbers, names of the HTML 5 table, and old names without a semicolon. Control characters and
    what is no character go, numbers out of range are replaced, unknown names stay."""
    table = F.from_json(F.lit(json.dumps(references())), "map<string,string>")

    def character(x: Column) -> Column:
        old = F.regexp_extract(x, UNCLOSED, 0)
        named = F.coalesce(F.element_at(table, x), F.when(old != "", F.concat(F.element_at(table, old), F.substr(x, F.length(old) + 1))), x)
        return F.when(F.startswith(x, F.lit("&#")), _numbered(x, table)).otherwise(named)

    found = F.transform(F.regexp_extract_all(text, F.lit(f"({REFERENCE})"), 1), character)
    return F.array_join(F.zip_with(F.split(text, REFERENCE, -1), found, lambda between, x: F.concat(between, F.coalesce(x, F.lit("")))), "")


def plain_text(markup: Column) -> Column:
    """Tags to spaces, references to characters, blanks to single spaces."""
    return flat(unescaped(F.regexp_replace(F.coalesce(markup, F.lit("")), "<[^>]*>", " ")))


def sanitized(text: Column, fragments: list[str] | tuple[str, ...]) -> Column:
    """Fragments removed until nothing more goes, blanks single and none before marks. A round that changes something takes a character at least,
    or a blank, so that a text's length bounds the rounds; they are nested three deep, so that after the last change few are left to pass over."""

    def once(t: Column) -> Column:
        for f in fragments:
            t = F.regexp_replace(t, f, " ")
        return F.trim(F.regexp_replace(F.regexp_replace(t, BLANKS, " "), " +([.,;:!?])", "$1"))

    def fixpoint(t: Column) -> Column:
        side = F.sequence(F.lit(1), F.ceil(F.cbrt(F.length(t) + 3)).cast("int") + 1)  # its third power is the bound

        def rounds(s: Column, level: int) -> Column:
            if level:
                return F.aggregate(side, s, lambda s, _: F.when(s["done"], s).otherwise(rounds(s, level - 1)))
            return held(once(s["text"]), lambda new: F.struct(new.alias("text"), (new == s["text"]).alias("done")))

        return rounds(F.struct(t.alias("text"), F.lit(False).alias("done")), 3)["text"]

    return held(F.coalesce(text, F.lit("")), fixpoint)


#: An end mark with closing marks before a capital or an opening mark; an abbreviation or initial at an end; a quotation's end; a speaker's clause.
CUT = r"""([.!?]["')\]”’]*) ([A-Z"'(“‘])"""
SHORT = r"""(?:^|[^A-Za-z0-9_])(?:Mr|Mrs|Ms|Dr|Prof|St|Gen|Sen|Rep|Gov|No|vs|etc|Inc|Jr|Sr|[A-Z](?:\.[A-Z])*)\.["')\]]*$"""
QUOTED = "[.!?][\"”'’]$"
#: The same two on reversed text, where they are looked for at its start alone.
SHORT_BACK = r"""^["')\]]*\.(?:rM|srM|sM|rD|forP|tS|neG|neS|peR|voG|oN|sv|cte|cnI|rJ|rS|(?:[A-Z]\.)*[A-Z])(?:[^A-Za-z0-9_]|$)"""
QUOTED_BACK = "^[\"”'’][.!?]"
ATTRIBUTION = "^(?:[^ ]+ ){0,3}(?:said|explained|recalled|insisted|concluded|commented|continued)(?:[^A-Za-z0-9_]|$)"


def sentences(text: Column) -> Column:
    """Sentences with their closing marks; abbreviations and initials do not end one, an open quotation goes on, and an attribution stays with
    its quotation."""

    def joined(pieces: Column) -> Column:
        count = lambda p, c: F.length(p) - F.length(F.replace(p, F.lit(c), F.lit("")))
        before = F.concat(F.array(F.lit("")), F.slice(pieces, 1, F.size(pieces) - 1))
        marks = F.zip_with(pieces, before, lambda p, b: F.struct(
            (count(p, '"') % 2 == 1).alias("odd"), (count(p, "“") - count(p, "”")).alias("open"),
            held(F.reverse(b), lambda r: F.rlike(r, F.lit(SHORT_BACK)) | (F.rlike(r, F.lit(QUOTED_BACK)) & F.rlike(p, F.lit(ATTRIBUTION)))).alias("bound"),
        ))

        def step(s: Column, m: Column) -> Column:
            on = m["bound"] | s["odd"] | (s["open"] > 0)
            return F.struct((m["odd"] != (on & s["odd"])).alias("odd"), (m["open"] + F.when(on, s["open"]).otherwise(0)).alias("open"), (~on).alias("starts"))

        states = running(marks, F.struct(F.lit(False).alias("odd"), F.lit(0).alias("open"), F.lit(True).alias("starts")), step)
        parts = F.zip_with(pieces, states, lambda p, s: F.concat(F.when(s["starts"], F.lit("\n")).otherwise(F.lit(" ")), p))
        return F.filter(F.split(F.array_join(parts, ""), "\n"), lambda x: x != "")

    return held(F.split(F.regexp_replace(flat(text), CUT, "$1\n$2"), "\n"), joined)


def narrative_sentences(text: Column, similar: float = 0.72, overlap: float = 0.66, patterns: list[str] = T.NON_NARRATIVE) -> Column:
    """Narrative, unclipped sentences that repeat no earlier one that stays."""
    good = F.filter(sentences(text), lambda s: ~T.is_non_narrative(s, patterns, squeezed=True) & ~T.looks_clipped(s, squeezed=True))
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))
    marked = lambda t: F.aggregate(t, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(bit(x)))
    worded = F.transform(good, lambda s: held(T.overlap_tokens(s), lambda t: F.struct(s.alias("s"), t.alias("t"), marked(t).alias("m"), F.size(t).alias("n"))))

    def repeats(x: Column, k: Column) -> Column:
        a, b = x["n"], k["n"]
        apart = lambda y, z: F.bit_count(y["m"].bitwiseAND(F.bitwise_not(z["m"])))  # noqa: E731  # tokens of y that z lacks, at least
        may = F.least(a - apart(x, k), b - apart(k, x)) >= F.least(similar * F.greatest(a, b), overlap * F.least(a, b)) - 1e-6
        near = held(F.size(F.array_intersect(x["t"], k["t"])), lambda n: (n / F.greatest(a, b) >= similar) | (n / F.least(a, b) >= overlap))
        return (x["s"] == k["s"]) | F.when((F.least(a, b) > 0) & may, near).otherwise(False)

    none = F.array().cast("array<struct<s:string,t:array<string>,m:bigint,n:int>>")
    kept = F.aggregate(worded, none, lambda kept, x: F.when(F.exists(kept, lambda k: repeats(x, k)), kept).otherwise(F.concat(kept, F.array(x))))
    return F.transform(kept, lambda k: k["s"])
