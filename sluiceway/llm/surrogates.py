"""Operator 10: surrogates for personal data, with DataFrame functions only.

Detected entities are replaced by made-up ones of the same type: mail addresses, network addresses,
card and account numbers, telephone numbers, secrets, and names that follow a title. A surrogate comes
from a keyed hash of the entity's canonical form, so the same entity in any format gets the same
surrogate in each mention's own format (digits stay digits, letters keep case and script, separators
and the country code of a telephone number stay; a card number that satisfies its check digit still does; a name keeps the gender of its title). Two
checks over the table of distinct entities make surrogates distinct from each other and from every
entity of their type: losers are hashed again with the next attempt until there are none. Where a format is
so crowded that losers remain after ``CROWDED`` attempts (as when over half of its forms are entities), the
entities of that format take each other's place instead: still one to one, and none keeps its own.

A name word may hold capitals, apostrophes and hyphens (O'Neil, McDonald, Jean-Paul) or be all capitals; a
possessive 's is not part of it. Initials between title and name stay. Groups of digits count as a telephone number if
they have a plus sign, an area code in parentheses, a leading zero, hyphens, or ten digits; thousands between dots and
book numbers are left alone.

Cases: null texts stay null; a text without entities stays as it is; equal texts are rewritten alike;
rows that repeat an id are all returned; other columns pass through; an empty table gives an empty result.

Patterns start at the beginning of a run and repeat possessively or up to a bound, so they are linear in
the text. Only texts with entities are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import fresh, land, table

KEY = "change me"
ATTEMPTS = 50
#: After so many attempts the entities of a crowded format take each other's place.
CROWDED = 30
#: About so many entities of a crowded format change places among themselves in one task.
CIRCLE = 10_000

MALE = "Mr|Mister|Sir|Herr|Monsieur|Señor|Signor|Don|господин|κύριος"
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Señora|Señorita|Signora|Doña|госпожа|κυρία"
NEUTRAL = "Dr|Prof|Professor|Mx"
NAME_WORD = r"\p{Lu}(?:[\p{L}\p{M}]|-(?=\p{L})|['’](?=\p{L})(?![sS](?!\p{L}))){1,40}+"
INITIALS = r"(?:\p{Lu}\. ){0,3}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
ALONE, END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Neither thousands between dots nor the inside of a book number; TEN: at least ten digits in three groups.
FIGURE = r"(?=\d)(?!\d{1,3}(?:\.\d{3})+(?!\d))(?<!97[89][ -])(?<!97[89][ -]\d{1,5}[ -])"
TEN = r"\d{2}[ .-]\d{4}[ .-]\d{4}|\d{3}[ .-](?:\d{3}[ .-]\d{4}|\d{4}[ .-]\d{3})|\d{4}[ .-]\d{3,4}[ .-]\d{3}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}+\.){1,8}\p{L}{2,24}+",
    "secret": ALONE + r"(?:[0-9a-fA-F]{32,128}+|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64}+)" + END,
    "ip": r"(?<![\p{L}\p{N}.])" + rf"(?:{OCTET}\.){{3}}{OCTET}" + r"(?!\p{L}|\p{N}|\.\d)",
    "iban": ALONE + r"[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?" + END,
    "card": ALONE + r"(?!97[89][ -]\d{1,5}[ -]\d{1,7}[ -]\d{1,7}[ -]\d(?!\d))" + r"\d(?:[ -]?\d){12,18}" + END,
    "national_id": ALONE + r"\d{3}-\d{2}-\d{4}" + END,
    "phone": r"(?<![\p{L}\p{N}+(])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}|\+\d{1,3}[ .-]?\d{2,4}[ .-]\d{3,4}"
    + rf"|{FIGURE}(?=0|\d{{2,4}}-\d{{3,4}}-|{TEN})\d{{2,4}}[ .-]\d{{3,4}})[ .-]\d{{3,4}}" + END
    + r"|(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?\d{2,4}[ .-]?\d{4,9}" + END,
    "name": rf"(?<!\p{{L}})(?:{MALE}|{FEMALE}|{NEUTRAL})\.? {INITIALS}{NAME_WORD}(?: {INITIALS}{NAME_WORD})?",
}
#: The country code that begins an international number: no code begins another, so digits alone tell it.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: Every entity holds a digit, an @, an underscore (some keys), one of these strings, or 32 hex letters.
HINTS = (
    "Mr", "Ms", "Mx", "Mister", "Miss", "Mada", "Mme", "Sir", "Herr", "Frau", "Monsieur", "Señor", "Signor", "Don ",
    "Don.", "Doña", "Dr", "Prof", "господин", "госпожа", "κύριος", "κυρία", "AKIA", "sk-",
)

SCRIPTS = {"Cyrillic": "абвгдежзиклмнопр", "Greek": "αβγδεζηθικλμνξοπ", "Han": "明华安平文国建伟丽芳静敏强军杰娟"}
LATIN, HEX = "bcdfghjkmnpqrstv", "0123456789abcdef"
#: Sixteen syllables for names in each script, and the endings of each gender.
SYLLABLES = {
    "Latin": ("ba ne ri lo ma te vi so ka le di no pa re mi tu", {"m": "n", "f": "la", "n": "ri"}),
    "Cyrillic": ("ба не ри ло ма те ви со ка ле ди но па ре ми ту", {"m": "н", "f": "ла", "n": "ри"}),
    "Greek": ("βα νε ρι λο μα τε βι σο κα λε δι νο πα ρε μι τυ", {"m": "ος", "f": "λα", "n": "ρι"}),
}


def _is(column: Column, pattern: str) -> Column:
    return column.rlike(f"^(?:{pattern})$")


def _plain(column: Column) -> Column:
    return F.lower(F.regexp_replace(column, r"[^\p{L}\p{N}]", ""))


def _stream(*parts: Column) -> Column:
    """256 keyed hexadecimal digits."""
    return F.concat(*[F.sha2(F.concat_ws("|", *parts, F.lit(n)), 512) for n in "01"])


def _script(canon: Column) -> Column:
    out = F.lit("Latin")
    for name in SCRIPTS:
        out = F.when(canon.rlike(rf"\p{{Is{name}}}"), F.lit(name)).otherwise(out)
    return out


def _parts(raws: DataFrame) -> DataFrame:
    """(raw, place, kind, canon, cell): what of each mention is replaced; names have one row a word."""
    raw = F.col("raw")
    kind = F.lit("name")
    for name, pattern in reversed(list(PATTERNS.items())[:-1]):
        kind = F.when(_is(raw, pattern), F.lit(name)).otherwise(kind)
    words = F.split(raw, " ")
    initial = r"^\p{Lu}\.$"
    title = F.regexp_replace(words[0], r"\.$", "")
    gender = F.when(_is(title, MALE), "m").when(_is(title, FEMALE), "f").otherwise("n")
    # kinds are evaluated once for each distinct mention
    typed = raws.select("raw", F.explode(F.array(kind)).alias("kind"))
    # octets without leading zeros; international numbers keep their plus sign
    canon = F.when(F.col("kind") == "ip", F.regexp_replace(raw, r"(?<!\d)0+(?=\d)", "")).when(
        (F.col("kind") == "phone") & raw.startswith("+"), F.concat(F.lit("+"), _plain(raw))
    ).when(F.col("kind") == "email", F.lower(raw)).otherwise(_plain(raw))
    single = typed.where("kind <> 'name'").select("raw", F.lit(0).alias("place"), "kind", canon.alias("canon"), raw.alias("cell"))
    named = (
        typed.where("kind = 'name'").select("raw", gender.alias("gender"), F.posexplode(words).alias("place", "cell"))
        .withColumn("last", F.col("place") == F.size(F.split("raw", " ")) - 1)
        .select(
            "raw", "place",
            F.when((F.col("place") == 0) | F.col("cell").rlike(initial), "title").when(F.col("last"), "family")
            .otherwise(F.concat(F.lit("given_"), "gender")).alias("kind"),
            F.lower(F.translate("cell", "’", "'")).alias("canon"), "cell",
        )
    )
    return single.unionByName(named)


def _luhn(digits: Column, skip_last: bool) -> Column:
    """The Luhn sum; without the last digit if asked."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = (n - i) % 2 == 1
        return F.when(doubled, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    upto = n - 1 if skip_last else n
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(upto, F.lit(1))), worth), F.lit(0), lambda a, x: a + x)


def _draw(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the digits and letters drawn for (kind, canon, attempt) in column ``drawn``: generated, not projected, so
    they are hashed once an entity instead of once a character."""
    kind, canon = F.col("kind"), F.col("canon")
    stream = _stream(F.lit(key), F.when(kind.startswith("given"), "given").otherwise(kind), canon, F.col("attempt"))
    df = df.select("*", F.explode(F.array(F.struct(stream.alias("stream"), _script(canon).alias("script")))).alias("seed"))
    stream, script = F.col("seed.stream"), F.col("seed.script")
    letters = F.translate(stream, HEX, LATIN)
    for name, alphabet in SCRIPTS.items():
        letters = F.when(script == name, F.translate(stream, HEX, alphabet)).otherwise(letters)
    return df.select("*", F.explode(F.array(F.struct(
        stream.alias("stream"), script.alias("script"), letters.alias("letters"),
        F.translate(stream, "abcdef", "024681").alias("digits"), F.translate(stream, "0123456789", "abcdefabcd").alias("hexed"),
    ))).alias("drawn")).drop("seed")


def _candidate(key: str) -> Column:
    """The surrogate in canonical form for (kind, canon, attempt, drawn)."""
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")
    stream, digits, letters, hexed, script = (F.col(f"drawn.{c}") for c in ("stream", "digits", "letters", "hexed", "script"))

    def shaped(text: Column, fixed: Column, hexadecimal: Column) -> Column:
        """Digits for digits and letters for letters, after ``fixed`` characters that stay."""
        def cell(i: Column) -> Column:
            c, at = F.substring(text, i, F.lit(1)), F.pmod(i - 1, F.lit(256)) + 1
            letter = F.when(hexadecimal, F.substring(hexed, at, F.lit(1))).otherwise(F.substring(letters, at, F.lit(1)))
            return (
                F.when((i <= fixed) | ~c.rlike(r"[\p{L}\p{N}]"), c)
                .when(c.rlike(r"\p{N}"), F.substring(digits, at, F.lit(1))).otherwise(letter)
            )
        return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), cell), "")

    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    host = F.translate(F.substring(_stream(F.lit(key), F.lit("domain"), domain, attempt), 1, 8), HEX, LATIN)
    top = F.element_at(F.array(*map(F.lit, ("com", "org", "net"))), F.pmod(F.crc32(domain.cast("binary")), F.lit(3)).cast("int") + 1)
    email = F.concat(shaped(local, F.lit(0), F.lit(False)), F.lit("@"), host, F.lit(".example."), top)

    byte = lambda at: F.conv(F.substring(stream, at, 2), 16, 10)
    ip = F.concat_ws(".", byte(1), byte(3), byte(5), byte(7))

    drawn = shaped(canon, F.lit(0), F.lit(False))
    check = F.pmod(-_luhn(drawn, True), F.lit(10))
    wrong = F.pmod(check + 1 + F.substring(digits, 200, 1).cast("int") % 9, F.lit(10))
    valid = _luhn(canon, False) % 10 == 0
    card = F.concat(drawn.substr(F.lit(1), F.length(drawn) - 1), F.when(valid, check).otherwise(wrong).cast("string"))

    size = 2 + F.floor(attempt / 3)
    name = F.lit("")
    for script_name, (syllables, endings) in SYLLABLES.items():
        cells = F.array(*map(F.lit, syllables.split()))
        built = F.array_join(F.transform(
            F.sequence(F.lit(1), size), lambda i: F.element_at(cells, F.conv(F.substring(stream, i, F.lit(1)), 16, 10).cast("int") + 1)
        ), "")
        ending = F.when(kind == "given_m", endings["m"]).when(kind == "given_f", endings["f"]).otherwise(endings["n"])
        second = F.array_join(F.transform(
            F.sequence(F.lit(101), size + 100), lambda i: F.element_at(cells, F.conv(F.substring(stream, i, F.lit(1)), 16, 10).cast("int") + 1)
        ), "")
        built = F.when(canon.contains("-"), F.concat(built, F.lit("-"), second)).otherwise(built)
        made = F.concat(built, F.when(kind == "family", F.lit("")).otherwise(ending))
        name = made if script_name == "Latin" else F.when(script == script_name, made).otherwise(name)

    return (
        F.when(kind == "title", canon).when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card)
        .when(kind.isin("family", "given_m", "given_f", "given_n"), name)
        .when(kind == "iban", shaped(canon, F.lit(2), F.lit(False)))
        .when(kind == "phone", shaped(canon, F.length(F.regexp_extract(canon, COUNTRY, 0)), F.lit(False)))
        .when(kind == "secret", shaped(canon, F.lit(0), canon.rlike("^[0-9a-f]+$")))
        .otherwise(shaped(canon, F.lit(0), F.lit(False)))
    )


def _digits(canon: Column) -> Column:
    """The form in which telephone numbers are compared: with or without a plus sign, only digits count."""
    return F.when(F.col("kind") == "phone", F.regexp_replace(canon, r"^\+", "")).otherwise(canon)


def surrogate_table(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon): one to one within a kind, and no surrogate
    is itself an entity of the kind, but in crowded formats, where entities change places."""
    space = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind"))
    now = land(
        _draw(_spread(entities, "kind", "canon").withColumn("attempt", F.lit(0)).withColumn("space", space), key)
        .withColumn("swapped", F.col("kind") == "title").withColumn("surrogate", _candidate(key)).drop("drawn"),
        "surrogates",
    )
    for attempt in range(1, ATTEMPTS + 1):
        now = now.withColumn("form", _digits(F.col("surrogate")))
        drawn = now.where(~F.col("swapped"))
        shared = drawn.groupBy("space", "form").agg(F.count("*").alias("n"), F.min(F.struct("canon", "kind")).alias("first")).where("n > 1")
        real = now.where("kind <> 'title'").select("space", _digits(F.col("canon")).alias("form")).distinct().withColumn("real", F.lit(True))
        lost = (
            drawn.join(shared, ["space", "form"], "left").join(real, ["space", "form"], "left")
            .where(F.col("real") | F.col("n").isNotNull() & (F.struct("canon", "kind") != F.col("first")))
            .select("kind", "canon")
        )
        lost = land(lost, "surrogates-lost")
        if lost.isEmpty():
            break
        if attempt == CROWDED:
            now = land(_swapped(now.drop("form"), lost, key), "surrogates")
            continue
        now = land(_again(now.drop("form"), lost, key), "surrogates")
    else:
        raise RuntimeError("surrogates run out: names of a script outnumber all that can be made")
    return now.select("kind", "canon", "surrogate")


def _again(now: DataFrame, lost: DataFrame, key: str) -> DataFrame:
    """``now`` with the next attempt of the lost entities."""
    tried = now.join(lost.withColumn("again", F.lit(1)), ["kind", "canon"], "left")
    tried = _draw(tried.withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0))), key)
    return tried.withColumn("surrogate", F.when(F.col("again") == 1, _candidate(key)).otherwise(F.col("surrogate"))).select(now.columns)


def _format() -> Column:
    """What a surrogate of (kind, canon) keeps: places of digits and letters, country, script, a valid check digit."""
    kind, canon = F.col("kind"), F.col("canon")
    kept = (
        F.when(kind == "iban", canon.substr(1, 2)).when(kind == "phone", F.regexp_extract(canon, COUNTRY, 0))
        .when(kind == "card", (_luhn(canon, False) % 10 == 0).cast("string"))
        .when(kind == "secret", canon.rlike("^[0-9a-f]+$").cast("string")).otherwise("")
    )
    shape = F.when(kind == "ip", "").otherwise(F.regexp_replace(F.regexp_replace(canon, r"\p{N}", "9"), r"\p{L}", "a"))
    return F.concat_ws("|", kept, _script(canon), shape)


def _swapped(now: DataFrame, lost: DataFrame, key: str) -> DataFrame:
    """``now`` with all entities of each format that holds lost ones in circles, where each takes the next one's
    canonical form. Names, which grow with the attempt, and addresses of mail are hashed on."""
    grows = F.col("kind").isin("email", "family", "given_m", "given_f", "given_n", "title")
    crowded = lost.where(~grows).withColumn("format", _format()).select("kind", "format").distinct().withColumn("crowded", F.lit(True))
    dealt = now.withColumn("format", _format()).join(crowded, ["kind", "format"], "left")
    sizes = dealt.where("crowded").groupBy("kind", "format").agg(F.ceil(F.count("*") / CIRCLE).cast("int").alias("circles"))
    order = F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon"), 256)
    circle = (
        dealt.where("crowded").join(sizes, ["kind", "format"]).withColumn("order", order)
        .withColumn("circle", F.pmod(F.xxhash64("order"), F.col("circles")))
    )
    ring = Window.partitionBy("kind", "format", "circle")
    moved = circle.withColumn("first", F.first("canon").over(ring.orderBy("order"))).withColumn(
        "surrogate", F.coalesce(F.lead("canon").over(ring.orderBy("order")), "first")
    ).withColumn("swapped", F.lit(True))
    # names and mail that lost are drawn again
    rest = _again(dealt.where("crowded is null").select(now.columns), lost, key)
    return rest.unionByName(moved.select(now.columns))


def _rendered() -> Column:
    """The canonical surrogate in the format of the mention's ``cell``."""
    cell, kind = F.col("cell"), F.col("kind")
    surrogate = _digits(F.col("surrogate"))

    def cased(i: Column) -> Column:
        c = F.substring(cell, i, F.lit(1))
        at = F.length(F.regexp_replace(F.substring(cell, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        new = F.substring(surrogate, at, F.lit(1))
        return F.when(~c.rlike(r"[\p{L}\p{N}]"), c).when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)

    shaped = F.array_join(F.transform(F.sequence(F.lit(1), F.length(cell)), cased), "")
    upper = (cell == F.upper(cell)) & (cell != F.lower(cell))
    return (
        F.when(kind == "title", cell).when(kind == "ip", surrogate)
        .when(kind == "email", F.when(upper, F.upper(surrogate)).otherwise(surrogate))
        .when(
            kind.isin("family", "given_m", "given_f", "given_n"),
            F.when(upper, F.upper(surrogate)).otherwise(F.array_join(F.transform(F.split(surrogate, "-"), F.initcap), "-")),
        )
        .otherwise(shaped)
    )


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all shuffle partitions: few bytes that cost much work are not merged into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def replacements(raws: DataFrame, key: str = KEY) -> DataFrame:
    """(raw, replacement) for distinct mentions."""
    parts = land(_parts(_spread(raws, "raw")), "mention-parts")
    made = surrogate_table(parts.select("kind", "canon").distinct(), key)
    return _spread(parts.join(made, ["kind", "canon"]), "raw").withColumn("new", _rendered()).groupBy("raw").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "new"))), lambda p: p["new"]), " ").alias("replacement")
    )


def with_surrogates(docs: DataFrame, key: str = KEY, count: str | None = None) -> DataFrame:
    """``docs`` with entities in ``text`` replaced; their number in column ``count`` if that is given."""
    mark, cells = fresh(docs, "_text_key"), fresh(docs, "_cells")
    # the cheap tests spare most texts the patterns
    hint = F.col("text").rlike(r"[0-9@_]")
    for word in HINTS:
        hint = hint | F.col("text").contains(word)
    hint = hint | F.col("text").rlike(r"[a-fA-F]{32}")
    found = F.coalesce(hint & F.col("text").rlike(ANY), F.lit(False))
    clean = docs.where(~found)
    marked = docs.where(found).withColumn(mark, F.sha2("text", 256))
    mentions = land(
        marked.select(mark, F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("place", "raw")).distinct(),
        "mentions",
    )
    made = replacements(mentions.select("raw").distinct(), key)
    lists = mentions.join(made, "raw").groupBy(mark).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "replacement"))), lambda p: p["replacement"]).alias(cells)
    )
    gaps = F.split("text", ANY, -1)
    text = F.concat(gaps[0], F.array_join(F.zip_with(cells, F.slice(gaps, F.lit(2), F.size(cells)), lambda r, g: F.concat(r, g)), ""))
    dirty = marked.join(lists, mark).withColumn("text", text)
    if count:
        clean, dirty = clean.withColumn(count, F.lit(0)), dirty.withColumn(count, F.size(cells))
    return clean.unionByName(dirty.drop(mark, cells))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_surrogates(docs, count="n_entities")


QUERIES = {"op10_surrogates": op10_surrogates}
ORACLES: dict[str, str] = {}
