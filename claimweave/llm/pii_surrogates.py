"""Surrogates for personal data: keyed, of the same type and format, distinct, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import query, stored, table

KEY = "surrogates-v1"
ATTEMPTS = 40

#: Words of address that announce a name, with the gender they tell.
MALE = ["Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "господин"]
FEMALE = ["Mrs", "Miss", "Madam", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа"]
OPEN = ["Ms", "Mx", "Dr", "Prof"]

EMAIL = r"(?<![\p{L}\p{N}._+-])[\p{L}\p{N}._+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63})+"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)"
#: No further group of a phone number begins where an address begins.
PHONE = rf"(?<![\d+])(?:\+\d{{1,3}}[ .-]?(?:\(\d{{2,4}}\)|\d{{2,4}})(?:(?![ .-]?{IP})[ .-]?\d{{2,4}}){{2,4}}|(?:\(\d{{3}}\) ?|\d{{3}}[-.])\d{{3}}[-.]\d{{4}})(?!\d)"
CARD = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
NAME_WORD = r"\p{Lu}[\p{L}'’-]+"
NAME = rf"(?=[MSHFDPг])(?<!\p{{L}})(?:{'|'.join([*MALE, *FEMALE, *OPEN])})\.? {NAME_WORD}(?: {NAME_WORD})?"
NUMBER = f"{IP}|{PHONE}|{CARD}"
ANY = f"{EMAIL}|{NUMBER}|{NAME}"

#: Letters that stand for letters, by script; what no row covers gets Latin ones.
SCRIPTS = [
    (r"[a-zß-ɏ]", "abcdefghijklmnopqrstuvwxyz"),
    (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшыэюя"),
    (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"\p{IsHan}", "山川田木林水火石金土月日花草竹米馬魚鳥虫雨雪風雲"),
]
SYLLABLES = ["ba", "de", "fi", "go", "lu", "ma", "ne", "ri", "so", "tu", "va", "ke", "li", "no", "ru", "sa"]
CYRILLIC = ["ба", "де", "фи", "го", "лу", "ма", "не", "ри", "со", "ту", "ва", "ке", "ли", "но", "ру", "са"]
KINDS = ["email", "ip", "phone", "card", "name"]


def kind_of(match: Column) -> Column:
    return (
        F.when(match.contains("@"), "email")
        .when(match.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$"), "ip")
        .when(match.rlike(r"^\p{L}"), "name")
        .when(match.rlike(r"^(\+|\(|\d{3}[-.]\d{3}[-.]\d{4}$)"), "phone")
        .otherwise("card")
    )


def matches_of(text: Column) -> Column:
    """All mentions in order.

    Only texts with an @ or a digit are searched for more than names, by what they hold; the patterns left out
    there can't match.
    """

    def every(pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)

    return F.when(text.contains("@"), every(ANY)).when(text.rlike("[0-9]"), every(f"{NUMBER}|{NAME}")).otherwise(every(NAME))


def _gender(title: Column) -> Column:
    bare = F.rtrim(F.regexp_replace(title, r"\.", ""))
    return F.when(bare.isin(MALE), "m").when(bare.isin(FEMALE), "f").otherwise("o")


def keys_of(match: Column) -> Column:
    """The things a match names, as ``kind:normal form``: one for most, given name and surname for a person.

    Case, blanks and punctuation don't tell two mentions apart; the last word after a word of address is the
    surname, which has no gender, so ``Mrs Ann Lee`` and ``Dr Lee`` share it.
    """
    kind = kind_of(match)
    words = F.split(match, " ")
    given = F.concat(F.lit("given_"), _gender(F.get(words, F.lit(0))), F.lit(":"), F.lower(F.get(words, F.lit(1))))
    surname = F.concat(F.lit("surname:"), F.lower(F.element_at(words, -1)))
    digits = F.regexp_replace(match, r"\D", "")
    return (
        F.when(kind == "name", F.when(F.size(words) > 2, F.array(given, surname)).otherwise(F.array(surname)))
        .when(kind.isin("phone", "card"), F.array(F.concat(kind, F.lit(":"), F.when(match.startswith("+"), "+").otherwise(""), digits)))
        .otherwise(F.array(F.concat(kind, F.lit(":"), F.lower(match))))
    )


def _noise(key: str, kind: Column, value: Column, attempt: int) -> Column:
    """256 hexadecimal digits from the key, the thing and the attempt."""
    parts = [F.sha2(F.concat_ws("|", F.lit(key), kind, value, F.lit(f"{attempt}.{i}")), 256) for i in range(4)]
    return F.concat(*parts)


def _number(noise: Column, at: Column) -> Column:
    """0 to 65535 from four digits of the noise, which is used again after 60 numbers."""
    return F.conv(F.substring(noise, F.pmod(at, F.lit(60)) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _swap(value: Column, noise: Column, keep: Column) -> Column:
    """Every letter and digit from place ``keep`` on replaced by another of its script, the rest as it is."""

    def one(c: Column, i: Column) -> Column:
        n = _number(noise, i)
        pick = lambda letters: F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))
        out = F.when(i < keep, c).when(c.rlike(r"\d"), F.pmod(n, F.lit(10)).cast("string"))
        for pattern, letters in SCRIPTS:
            out = out.when(c.rlike(pattern), pick(letters))
        return out.when(c.rlike(r"[\p{L}\p{N}]"), pick(SCRIPTS[0][1])).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits of a number, every second from the right doubled, modulo 10."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(F.pmod(i, F.lit(2)) == 1, doubled).otherwise(d)

    each = F.transform(F.split(F.reverse(digits), ""), worth)
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, b: a + b), F.lit(10))


def surrogate(kind: Column, value: Column, key: str, attempt: int) -> Column:
    """A replacement in normal form; later attempts are longer, so that a crowded format runs out of none.

    Emails keep the shape of both sides and the top domain, addresses stay private or public,
    phones keep sign and country digits, cards their issuer digit and whether the check digit holds, names gender and script.
    """
    noise = _noise(key, kind, value, attempt)
    longer = "0" * max(0, attempt - 7)
    host = F.substring_index(value, "@", -1)
    host_noise = _noise(key, F.lit("host"), host, 0)
    top = F.substring_index(host, ".", -1)
    labels = host.substr(F.lit(1), F.length(host) - F.length(top) - 1)
    local = F.concat(F.substring_index(value, "@", 1), F.lit(longer))
    email = F.concat(_swap(local, noise, F.lit(0)), F.lit("@"), _swap(labels, host_noise, F.lit(0)), F.lit("."), top)
    private = r"^(?:10|127|192\.168|172\.(?:1[6-9]|2\d|3[01]))\."
    octet = lambda i: (F.pmod(_number(noise, F.lit(i)), F.lit(254)) + 1).cast("string")
    public = F.element_at(F.array(*[F.lit(str(n)) for n in range(1, 224) if n not in (10, 127, 172, 192)]), F.pmod(_number(noise, F.lit(0)), F.lit(219)) + 1)
    ip = F.when(value.rlike(private), F.concat(F.regexp_extract(value, private, 0), F.when(value.rlike(r"^(?:10|127)\."), F.concat(octet(1), F.lit("."))).otherwise(""), octet(2), F.lit("."), octet(3)))
    ip = ip.otherwise(F.concat_ws(".", public, octet(1), octet(2), octet(3)))
    country = F.when(value.rlike(r"^\+[17]"), 2).when(value.startswith("+"), 3).otherwise(0)
    phone = _swap(F.concat(value, F.lit(longer)), noise, country)
    body = value.substr(F.lit(1), F.length(value) - 1)
    drawn = _swap(F.concat(body, F.lit(longer)), noise, F.lit(1))
    fitting = F.pmod(10 - luhn_sum(F.concat(drawn, F.lit("0"))), F.lit(10))
    off = F.when(luhn_sum(value) == 0, 0).otherwise(1 + F.pmod(_number(noise, F.lit(59)), F.lit(9)))
    card = F.concat(drawn, F.pmod(fitting + off, F.lit(10)).cast("string"))
    syllable = lambda table, i: F.element_at(F.array(*[F.lit(s) for s in table]), F.pmod(_number(noise, F.lit(i)), F.lit(len(table))) + 1)
    spoken = lambda table: F.concat(*[syllable(table, i) for i in range(4 + attempt)])
    cyrillic = value.rlike(r"\p{IsCyrillic}")
    ending = F.when(kind == "given_f", F.when(cyrillic, "на").otherwise("na")).when(kind == "given_m", F.when(cyrillic, "н").otherwise("n")).otherwise("")
    name = F.concat(F.when(cyrillic, spoken(CYRILLIC)).otherwise(spoken(SYLLABLES)), ending)
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card).otherwise(name)


def surrogate_table(things: DataFrame, key: str = KEY, attempts: int = ATTEMPTS) -> DataFrame:
    """(thing, surrogate) for distinct ``kind:normal form`` strings; no two of a kind share one, and none is another's original.

    In each round every open thing draws a candidate.  It is taken by the smallest thing that drew it,
    unless it was taken before or occurs in the corpus; the others draw again.
    """
    split = things.select("thing", F.substring_index("thing", ":", 1).alias("kind"), F.expr("substring(thing, instr(thing, ':') + 1)").alias("value"))
    originals = stored(split)
    open_, done = originals, None
    for attempt in range(attempts):
        drawn = stored(open_.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), key, attempt)))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("thing").alias("thing"))
        barred = originals.select("kind", F.col("value").alias("surrogate"))
        won = first.join(barred, ["kind", "surrogate"], "left_anti")
        if done is not None:
            won = won.join(done, ["kind", "surrogate"], "left_anti")
        won = stored(won.select("kind", "surrogate", "thing"))
        done = won if done is None else done.unionByName(won)
        open_ = drawn.drop("surrogate").join(won, "thing", "left_anti")
        if open_.isEmpty():
            return done.select("thing", "surrogate")
        open_ = stored(open_)
    raise RuntimeError(f"no free surrogate after {attempts} rounds")


def _refill(match: Column, digits: Column) -> Column:
    """The digits of a phone or card number written into the format of a mention; digits over follow at the end."""
    chars = F.split(match, "")
    nth = lambda i: F.length(F.regexp_replace(F.array_join(F.slice(chars, F.lit(1), i + 1), ""), r"\D", ""))
    filled = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"\d"), F.substring(digits, nth(i), F.lit(1))).otherwise(c)), "")
    count = F.length(F.regexp_replace(match, r"\D", ""))
    return F.concat(filled, digits.substr(count + 1, F.lit(64)))


def _cased(word: Column, like: Column) -> Column:
    return F.when((F.length(like) > 1) & (F.upper(like) == like), F.upper(word)).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word))))


def rendered(match: Column, names: Column) -> Column:
    """A mention with its surrogate, from the map of things to surrogates: its own case, format and word of address."""
    kind, keys, words = kind_of(match), keys_of(match), F.split(match, " ")
    of = lambda i: F.element_at(names, F.element_at(keys, i))
    surname = _cased(of(-1), F.element_at(words, -1))
    person = F.when(F.size(words) > 2, F.concat_ws(" ", F.get(words, F.lit(0)), _cased(of(1), F.get(words, F.lit(1))), surname)).otherwise(F.concat_ws(" ", F.get(words, F.lit(0)), surname))
    plain = F.when((kind == "email") & (F.upper(match) == match), F.upper(of(1))).otherwise(of(1))
    return F.when(kind == "name", person).when(kind.isin("phone", "card"), _refill(match, F.regexp_replace(of(1), r"\D", ""))).otherwise(plain)


def replace_pii(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with ``text`` rewritten and ``entities`` array<struct<kind, start, surrogate>>, offsets in the new text.

    Emails, IPv4 addresses, phone numbers, card-like numbers and names after a word of address are
    found by pattern.  One thing has one surrogate in the whole corpus (coreference), two
    things have two (distinctness), and the same key gives the same surrogates for the same corpus.
    Null and empty texts have no entities.  Repeated rows are rewritten alike; rows with a null id
    too, since surrogates go by what is found, not by the row.  No rows give no rows.  Only the id,
    the text and the entities are returned.

    Texts without a match are rewritten where they are read.  Of the others the distinct things per
    document go to the corpus-wide table and come back as a map for each document, so a thing that a third
    of all documents mention is a row a document in a join whose skew Spark splits.
    """
    slim = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    # through a generator, so that a filter on the matches doesn't search the text a second time
    found = slim.select("doc", "text", F.explode_outer(F.array(matches_of(F.col("text")))).alias("matches"))
    some = found.filter(F.size("matches") > 0)
    things = some.select("doc", F.explode(F.array_distinct(F.flatten(F.transform("matches", keys_of)))).alias("thing"))
    things = stored(things.distinct())
    chosen = surrogate_table(things.select("thing").distinct(), key)
    maps = things.join(chosen, "thing").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("thing", "surrogate"))).alias("names"))
    maps = maps.withColumnRenamed("doc", "_doc")
    met = some.join(maps, F.col("doc").eqNullSafe(F.col("_doc")))
    swapped = met.select("doc", F.split("text", ANY, -1).alias("rest"), F.transform("matches", kind_of).alias("kinds"), F.transform("matches", lambda m: rendered(m, F.col("names"))).alias("new"))
    pieces = F.flatten(F.zip_with("rest", "new", lambda a, b: F.array(a, F.coalesce(b, F.lit("")))))
    starts = F.aggregate(
        F.zip_with("rest", "new", lambda a, b: F.struct(F.length(a).alias("a"), F.coalesce(F.length(b), F.lit(0)).alias("b"))),
        F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("all")),
        lambda acc, x: F.struct((acc["end"] + x["a"] + x["b"]).alias("end"), F.concat(acc["all"], F.array(acc["end"] + x["a"])).alias("all")),
    )["all"]
    told = F.zip_with(F.arrays_zip("kinds", "new"), F.slice(starts, F.lit(1), F.size("new")), lambda e, s: F.struct(e["kinds"].alias("kind"), s.alias("start"), e["new"].alias("surrogate")))
    kind = "array<struct<kind: string, start: int, surrogate: string>>"
    changed = swapped.select(F.col("doc").alias(id_col), F.array_join(pieces, "").alias("text"), told.cast(kind).alias("entities"))
    same = found.filter((F.size("matches") <= 0) | F.col("matches").isNull())
    return changed.unionByName(same.select(F.col("doc").alias(id_col), "text", F.array().cast(kind).alias("entities")))


@query("op1_pii_surrogates")
def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents"))
