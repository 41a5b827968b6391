"""Scalar functions as column expressions; all of them run in the JVM."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

# -- bits and numbers


def has(mask: Column, bits: int) -> Column:
    """Whether all ``bits`` are set; false for null."""
    return F.coalesce(mask.bitwiseAND(F.lit(bits)) == F.lit(bits), F.lit(False))


def first_of(mask: Column, names: list[str], bits: list[int]) -> Column:
    """The first name whose bit is set, else null."""
    return F.coalesce(*(F.when(mask.bitwiseAND(F.lit(b)) != 0, F.lit(n)) for n, b in zip(names, bits, strict=True)))


def decode_attribute(mask: Column) -> Column:
    return first_of(mask, vocab.ATTRIBUTES, [1 << i for i in range(len(vocab.ATTRIBUTES))])


def decode_race(mask: Column) -> Column:
    return first_of(mask, vocab.RACES, [1 << i for i in range(len(vocab.RACES))])


def decode_category(mask: Column) -> Column:
    """MONSTER, SPELL or TRAP; null where no such bit is set (those records are rejected)."""
    return first_of(mask, list(vocab.CATEGORIES), [1, 2, 4])


def decode_sub_category(mask: Column, category: Column) -> Column:
    named = lambda names: first_of(mask, names, [vocab.TYPE_BIT[n] for n in names])
    return F.when(category == "MONSTER", F.coalesce(named(vocab.FRAME_ORDER), F.lit("NORMAL"))).when(
        category.isNotNull(), F.coalesce(named(vocab.SPELL_TRAP_ORDER), F.lit("NORMAL"))
    )


def decode_flags(mask: Column) -> Column:
    """The flags that are set, sorted."""
    return F.sort_array(F.array_compact(F.array(*(F.when(has(mask, vocab.TYPE_BIT[f]), F.lit(f)) for f in vocab.FLAGS))))


def decode_level(packed: Column) -> Column:
    return F.nullif(packed.bitwiseAND(F.lit(255)), F.lit(0)).cast("int")


def decode_scale(packed: Column) -> Column:
    return F.nullif(F.shiftright(packed, 16).bitwiseAND(F.lit(255)), F.lit(0)).cast("int")


def decode_link_rating(packed: Column, is_link: Column) -> Column:
    return F.when(is_link, decode_level(packed))


def decode_setcode(packed: Column) -> Column:
    """Up to four codes of 16 bits, as lower-case hex; zeros are left out."""
    codes = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda i: F.lpad(F.lower(F.hex(F.call_function("shiftrightunsigned", packed, (i * 16).cast("int")).bitwiseAND(F.lit(65535)))), 4, "0"),
    )
    return F.filter(codes, lambda x: x != "0000")


def zero_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(0))


def contains_number(op: Column, bound: Column, value: Column) -> Column:
    """Whether ``value`` fulfils a stored bound."""
    return (
        F.when(op == "<=", value <= bound).when(op == ">=", value >= bound).when(op.isin("=", "=="), value == bound)
        .when(op == "<", value < bound).when(op == ">", value > bound)
    )


def confidence(action: Column, source: Column, destination: Column, has_object: Column) -> Column:
    """How sure a predicate is, from what is known of it (nulls are unknown)."""
    score = (
        F.lit(0.25) + F.when(action.isNotNull(), 0.35).otherwise(0.0) + F.when(source.isNotNull(), 0.15).otherwise(0.0)
        + F.when(destination.isNotNull(), 0.10).otherwise(0.0) + F.when(has_object, 0.15).otherwise(0.0)
    )
    return F.round(F.least(score, F.lit(1.0)), 3)


def tri(value: Column) -> Column:
    """TRUE, FALSE or UNKNOWN of a nullable boolean."""
    return F.when(value.isNull(), "UNKNOWN").when(value, "TRUE").otherwise("FALSE")


# -- text


def slugify(text: Column) -> Column:
    """Lower case, with a hyphen for each run of white space, hyphens, underscores and slashes; none at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"[\s\-_/]+", "-"), "^-+|-+$", ""))


def normalize_text(text: Column) -> Column:
    """Line ends as LF, and no white space at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"^\s+|\s+$", "")


def mask_quoted(text: Column, mark: str = "◆") -> Column:
    """What stands in corner quotes (1 to 60 characters) as so many marks."""
    pieces = F.split(text, "(?<=「)(?=[^」]{1,60}」)|(?<=「[^」「]{1,60})(?=」)")
    return F.array_join(F.transform(pieces, lambda x, i: F.when((i % 2 == 1) & ~x.contains("「"), F.repeat(F.lit(mark), F.length(x))).otherwise(x)), "")


def quoted_names(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("「([^」]{1,60})」"), 1), lambda x: F.trim(x))


def subject(text: Column) -> Column:
    return (
        F.when(text.contains("对方"), "OPPONENT").when(text.contains("自己"), "SELF")
        .when(text.contains("双方") | text.contains("玩家"), "PLAYER").otherwise("ANY")
    )


def longest_first(text: Column, words: dict[str, str]) -> Column:
    """The value of the longest word that the text contains; words of equal length in their order."""
    ordered = sorted(words.items(), key=lambda kv: -len(kv[0]))
    return functools.reduce(lambda c, kv: c.when(text.contains(kv[0]), kv[1]), ordered[1:], F.when(text.contains(ordered[0][0]), ordered[0][1]))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def identity_key(passcode: Column, lang: Column, name: Column) -> Column:
    """passcode:N, or name:LANG:NAME for records without one (null, empty or 0)."""
    known = passcode.isNotNull() & ~passcode.isin("", "0")
    return F.when(known, F.concat(F.lit("passcode:"), passcode)).otherwise(F.concat(F.lit("name:"), lang, F.lit(":"), F.lower(name)))


def race_token(text: Column) -> Column:
    """A race as the registry writes it: words joined by underscores; another spelling by its entry."""
    token = F.upper(F.regexp_replace(F.regexp_replace(F.trim(text), r"[\s\-_/]+", "_"), "^_+|_+$", ""))
    return functools.reduce(lambda c, kv: F.when(c == kv[0], kv[1]).otherwise(c), vocab.RACE_ALIASES.items(), token)
