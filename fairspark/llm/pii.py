"""Personal data replaced by keyed surrogates of the same kind and form, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairspark.llm.tables import stored

_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Señora"
_MALE = "Mr|Herr|Monsieur|Señor"
#: What may stand between a title and a name and tells no gender.
_RANK = "Dr|Prof|Professor|Doktor|Ing|Sir|Dame"
#: Small words that belong to a name and stay.
_PARTICLE = "von|van|vom|zu|zum|zur|der|den|de|del|della|di|da|do|dos|du|des|la|le|ten|ter|af|av|bin|ibn|al|el|y|e"
_TITLE = rf"(?:{_FEMALE}|{_MALE})\.?(?: (?:{_FEMALE}|{_MALE}|{_RANK})\.?(?![\p{{L}}\p{{M}}'’\-]))*+ "
#: A name up to its letter border, with inner capitals, hyphens and apostrophes, without a possessive s.
_NAME = r"\p{Lu}(?:(?!['’]s(?!\p{L}))['’\-]?[\p{L}\p{M}])+"
_NAMED = rf"(?:(?:{_PARTICLE}) |\p{{Lu}}\. )*{_NAME}"
#: What is personal data, by kind. Every pattern holds its own borders and no capturing group.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}",
    "secret": r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,}(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])",
    "card": r"(?<![\p{L}\p{N}+])[0-9]{4}(?:[ \-]?[0-9]{4}){3}(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])",
    # Groups of 3, 3 and 4 digits; any groups of 8 digits or more after a country code; five pairs after a 0.
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[ .\-][0-9]{3}[ .\-][0-9]{4}(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}+])\+(?=(?:[ .\-()]*[0-9]){8})[0-9]{1,3}[ .\-](?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{1,4}(?:[ .\-][0-9]{2,8}){1,4}(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}+])0[1-9](?:[ .\-][0-9]{2}){4}(?![\p{L}\p{N}])",
    "person": rf"(?<!\p{{L}}){_TITLE}{_NAMED}(?: {_NAMED}){{0,2}}",
}
PATTERN = "|".join(KINDS.values())
#: Texts without any of these hold no personal data; this cheap test comes first.
HINT = rf"[0-9@]|(?:{_FEMALE}|{_MALE})\.? "
#: Alphabets by script; a letter is replaced by one of its own script.
ALPHABETS = {"Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω"}
_LATIN = "abcdefghijklmnopqrstuvwxyz"
_ONSETS, _VOWELS = "bdfgklmnprstvwz", "aeiou"
#: Draws for one value before the numbers of its form count as used up.
ATTEMPTS = 24
#: Draws after which names and addresses grow by a syllable or letter.
GROWTH = 3


def _kind(value: Column) -> Column:
    out = F.lit("person")
    for kind in reversed([k for k in KINDS if k != "person"]):
        out = F.when(value.rlike(f"^(?:{KINDS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _identity(kind: Column, value: Column) -> Column:
    """What two mentions of the same thing share: no letter case, no separators of digits."""
    country = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .\-(])", 0)
    digits = F.regexp_replace(F.substring(value, F.length(country) + 1, F.length(value)), "[^0-9]", "")
    return (
        F.when(kind == "phone", F.concat(country, F.lit("|"), digits))
        .when(kind.isin("card", "ssn"), F.regexp_replace(value, "[^0-9]", ""))
        .otherwise(F.lower(value))
    )


def _draw(digest: Column, i: Column) -> Column:
    """The i-th number from 0 to 255 of a digest of 128 hex digits, starting again at its end."""
    return F.conv(F.substring(digest, F.pmod(2 * i, F.lit(128)) + 1, F.lit(2)), 16, 10).cast("int")


def _from(alphabet: str, draw: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(draw, F.lit(len(alphabet))) + 1, F.lit(1))


def _letters(value: Column, digest: Column) -> Column:
    """Each letter and digit replaced by another of its script; signs stay."""

    def one(i: Column) -> Column:
        c, d = F.substring(value, i + 1, F.lit(1)), _draw(digest, i)
        out = F.when(c.rlike("[0-9]"), _from("0123456789", d))
        for script, alphabet in ALPHABETS.items():
            out = out.when(c.rlike(rf"\p{{Is{script}}}"), _from(alphabet, d))
        return out.when(c.rlike(r"[\p{L}\p{N}]"), _from(_LATIN, d)).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(value) - 1), one), "")


def _bare(kind: Column, identity: Column) -> Column:
    """An identity without the tag that tells the role of a name."""
    return F.when(kind == "person", F.substring(identity, F.lit(3), F.length(identity))).otherwise(identity)


def _surrogate(kind: Column, identity: Column, key: str, attempt: int) -> Column:
    """Candidate identity of the same kind, from a keyed digest; another one for each attempt.

    Names and addresses grow with the attempts, so they never run out.
    """
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, identity, F.lit(str(attempt))), 512)
    grown = attempt // GROWTH
    ending = F.regexp_extract(identity, r"\.\p{L}{2,}$", 0)
    more = [_from(_LATIN, _draw(digest, F.lit(63 - k))) for k in range(grown)]
    address = F.concat(*more, _letters(F.substring(identity, F.lit(1), F.length(identity) - F.length(ending)), digest), ending)
    country = F.substring_index(identity, "|", 1)
    number = F.concat(country, F.lit("|"), _letters(F.substring_index(identity, "|", -1), digest))

    def octet(part: Column, i: Column) -> Column:
        d, size = _draw(digest, 2 * i) * 256 + _draw(digest, 2 * i + 1), F.length(part)
        return F.when(size == 3, 100 + F.pmod(d, F.lit(156))).when(size == 2, 10 + F.pmod(d, F.lit(90))).otherwise(F.pmod(d, F.lit(10))).cast("string")

    tag, bare = F.substring(identity, F.lit(1), F.lit(2)), _bare(kind, identity)
    syllables = 2 + grown

    def name(part: Column, i: Column) -> Column:
        at = (2 * syllables + 3) * i
        stem = F.concat(*[_from((_ONSETS, _VOWELS)[k % 2], _draw(digest, at + k)) for k in range(2 * syllables + 1)])
        family = F.concat(_from(_VOWELS, _draw(digest, at + 2 * syllables + 1)), _from("nrst", _draw(digest, at + 2 * syllables + 2)))
        return F.concat(stem, F.when(tag == "f|", F.lit("a")).when(tag == "m|", F.lit("o")).otherwise(family))

    other = bare.rlike("|".join(rf"\p{{Is{s}}}" for s in ALPHABETS))
    longer = F.concat(bare, F.repeat(F.substring(bare, -1, 1), F.lit(grown)))
    spelled = F.when(other, _letters(longer, digest)).otherwise(F.array_join(F.transform(F.split(bare, "-"), name), "-"))
    hexed = F.array_join(F.transform(F.sequence(F.lit(0), F.length(identity) - 1), lambda i: _from("0123456789abcdef", _draw(digest, i))), "")
    return (
        F.when(kind == "email", address)
        .when(kind == "secret", hexed)
        .when(kind == "ip", F.array_join(F.transform(F.split(identity, r"\."), octet), "."))
        .when(kind == "phone", number)
        .when(kind.isin("card", "ssn"), _letters(identity, digest))
        .otherwise(F.concat(tag, spelled))
    )


def _swapped(values: DataFrame, open_values: DataFrame, key: str) -> DataFrame:
    """Surrogates for values whose form has no free number left: each takes the next one of its form, in keyed order."""
    form = F.regexp_replace("identity", "[0-9]", "0")
    ends = values.groupBy("kind", form.alias("form")).agg(F.min("identity").alias("low"), F.max("identity").alias("high"))
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.col("kind"), F.col("identity")), 256)
    order = Window.partitionBy("kind", "form").orderBy("digest", "identity")
    chain = open_values.withColumn("form", form).withColumn("digest", digest)
    first = F.first("identity").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chain = chain.withColumn("next", F.coalesce(F.lead("identity").over(order), first)).join(ends, ["kind", "form"])
    lone = F.when(F.col("low") != F.col("identity"), F.col("low")).otherwise(F.col("high"))
    return chain.select("kind", "identity", F.when(F.col("next") != F.col("identity"), F.col("next")).otherwise(lone).alias("surrogate"))


def surrogates(values: DataFrame, key: str, attempts: int = ATTEMPTS) -> DataFrame:
    """``kind, identity, surrogate`` for distinct ``kind, identity``: keyed, distinct and no value that occurs.

    All values draw a candidate. Where candidates collide with each other, with one accepted earlier or
    with an original, all but the first value draw again, until none collides; later rounds draw and
    group only what still collides and look it up among the others. Names and addresses grow
    by a syllable or letter every few rounds. Numbers keep their length: where after ``attempts`` rounds a
    form has no free number left to find, its remaining values are dealt among themselves, distinct and
    none to itself, so that such a surrogate is another value's original.
    """
    open_values = values
    accepted = None
    for attempt in range(attempts):
        drawn = open_values.withColumn("surrogate", _surrogate(F.col("kind"), F.col("identity"), key, attempt))
        drawn = stored(drawn.withColumn("form", _bare(F.col("kind"), F.col("surrogate"))), "drawn")
        taken = values.select("kind", _bare(F.col("kind"), F.col("identity")).alias("form"))
        if accepted is not None:
            taken = taken.unionByName(accepted.select("kind", _bare(F.col("kind"), F.col("surrogate")).alias("form")))
        hit = taken.join(drawn.select("kind", "form"), ["kind", "form"], "left_semi").distinct().withColumn("taken", F.lit(True))
        first = drawn.groupBy("kind", "form").agg(F.min("identity").alias("first")).join(hit, ["kind", "form"], "left")
        told = drawn.join(first, ["kind", "form"]).withColumn("ok", F.col("taken").isNull() & (F.col("identity") == F.col("first")))
        told = stored(told.select("kind", "identity", "surrogate", "ok"), "told")
        fine = told.where("ok").select("kind", "identity", "surrogate")
        accepted = fine if accepted is None else accepted.unionByName(fine)
        open_values = told.where("not ok").select("kind", "identity")
        if open_values.isEmpty():
            return accepted
    return accepted.unionByName(_swapped(values, open_values, key))


def _case(value: Column, lowered: Column) -> Column:
    """Letter case of the original: all capitals, a capital first, or as drawn."""
    return (
        F.when((F.upper(value) == value) & (F.lower(value) != value), F.upper(lowered))
        .when(F.substring(value, 1, 1) != F.lower(F.substring(value, 1, 1)), F.array_join(F.transform(F.split(lowered, "-"), F.initcap), "-"))
        .otherwise(lowered)
    )


def _rendered(kind: Column, value: Column, drawn: Column) -> Column:
    """A surrogate identity in the form of the mention it replaces."""
    digits = F.when(kind == "phone", F.substring_index(drawn, "|", -1)).otherwise(drawn)
    country = F.when(kind == "phone", F.substring_index(drawn, "|", 1)).otherwise(F.lit(""))
    rest = F.substring(value, F.length(country) + 1, F.length(value))

    def one(i: Column) -> Column:
        c = F.substring(rest, i + 1, F.lit(1))
        place = F.length(F.regexp_replace(F.substring(rest, F.lit(1), i + 1), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]"), F.substring(digits, place, F.lit(1))).otherwise(c)

    filled = F.concat(country, F.array_join(F.transform(F.sequence(F.lit(0), F.length(rest) - 1), one), ""))
    plain = F.when(kind == "person", F.substring(drawn, F.lit(3), F.length(drawn))).otherwise(drawn)
    return F.when(kind.isin("phone", "card", "ssn"), filled).otherwise(_case(value, plain))


def replace_pii(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All rows with personal data in ``text_col`` replaced, and what was replaced.

    Kinds: e-mail addresses, hexadecimal secrets, IPv4 addresses, card, social security and phone numbers,
    and persons after a title: one to three names, each up to its letter border, with further titles, initials
    and particles, which stay. A surrogate is drawn from a digest under ``key``: the same value gets the same
    one everywhere, whatever its letter case or separators (each name on its own, so "Mr. A B" and "Mr. B"
    stay together whatever capitalised word follows); different values get different ones, which are no
    original either. Kind, script, length of numbers, separators, hyphens, country code, domain ending, letter
    case and, for given names, the gender of the title are kept. A name counts as given if in most of its
    mentions another follows, else (ties too) as a family name.

    Mentions are split off each text once and only they are shuffled to meet their surrogates; a value
    that fills a large share of all mentions is left to the skew handling of the join. Rows with mentions
    come back by a row number from a written table; rows without any are not shuffled.

    Null texts stay null, empty ones empty. Repeated rows are replaced alike. All columns of ``docs`` are
    kept under their names and the new ones are in a struct, ``doc``: the row with its new text,
    ``found``: the kinds in the order of the text.
    """
    text = F.col(f"doc.`{text_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    mentions = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("mentions", F.coalesce(mentions, F.array().cast("array<string>")))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "mentions")

    with_some = rows.where(F.size("mentions") > 0)
    each = with_some.select("row", F.posexplode("mentions").alias("at", "value")).withColumn("kind", _kind(F.col("value")))
    # A person is titles and names; each name is a value of its own, what stands before it is kept.
    is_person = F.col("kind") == "person"
    title = F.regexp_extract("value", f"^{_TITLE}", 0)
    after = F.substring(F.col("value"), F.length(title) + 1, F.length("value"))
    names, gaps = F.regexp_extract_all(after, F.lit(_NAME), F.lit(0)), F.split(after, _NAME, -1)
    given = lambda i: (i < F.size(names) - 1).cast("int")
    named = F.transform(
        names, lambda n, i: F.struct(F.concat(F.when(i == 0, title).otherwise(F.lit("")), F.element_at(gaps, i + 1)).alias("before"), n.alias("part"), given(i).alias("given"))
    )
    single = F.array(F.struct(F.lit("").alias("before"), F.col("value").alias("part"), F.lit(0).alias("given")))
    gender = F.when(~is_person, F.lit("")).when(F.col("value").rlike(rf"^(?:{_FEMALE})\.? "), F.lit("f|")).otherwise(F.lit("m|"))
    parts = each.select("row", "at", "kind", gender.alias("gender"), F.posexplode(F.when(is_person, named).otherwise(single)).alias("k", "p"))
    parts = parts.select("row", "at", "k", "kind", "gender", "p.before", "p.part", "p.given", _identity(F.col("kind"), F.col("p.part")).alias("name"))
    parts = stored(parts, "parts")

    # A name that stands before another one in most of its mentions is a given name everywhere, else a family name.
    uses = parts.select("kind", "name", "gender").distinct()
    roles = parts.where(is_person).groupBy("kind", "name").agg((2 * F.sum("given") > F.count("*")).alias("is_given"))
    tag = F.when(~is_person, F.lit("")).when(F.col("is_given"), F.col("gender")).otherwise(F.lit("l|"))
    uses = uses.join(roles, ["kind", "name"], "left").select("kind", "name", "gender", F.concat(tag, "name").alias("identity"))
    uses = stored(uses, "uses")
    chosen = uses.join(surrogates(uses.select("kind", "identity").distinct(), key), ["kind", "identity"]).drop("identity")

    joined = parts.join(chosen, ["kind", "name", "gender"]).withColumn("new", F.concat("before", _rendered(F.col("kind"), F.col("part"), F.col("surrogate"))))
    lists = joined.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "k", "new", "kind"))).alias("list"))
    # Names of one person come back together, then each text is put together from what lies between mentions.
    heads = F.filter("list", lambda x: x["k"] == 0)
    per_mention = F.transform(heads, lambda h: F.array_join(F.transform(F.filter("list", lambda x: x["at"] == h["at"]), lambda x: x["new"]), ""))
    lists = lists.select("row", per_mention.alias("new"), F.transform(heads, lambda h: h["kind"]).alias("found"))
    between = F.split(text, PATTERN, -1)
    pieces = F.transform(F.arrays_zip(between.alias("old"), F.col("new").alias("new")), lambda x: F.concat(x["old"], F.coalesce(x["new"], F.lit(""))))
    replaced = with_some.join(lists, "row").select("doc", F.array_join(pieces, "").alias("text"), "found")
    plain = rows.where(F.size("mentions") == 0).select("doc", text.alias("text"), F.array().cast("array<string>").alias("found"))
    both = replaced.unionByName(plain)
    fields = [F.col("text").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    return both.select(F.struct(*fields).alias("doc"), "found")
