"""PII: surrogate generation with built-in DataFrame functions only.

Entities (e-mail, IPv4, IPv6, phone, payment card, IBAN, US social security number, access key, assigned secret, titled
name) are found with one pattern. A bare number of 13 to 19 digits is a card only if its Luhn sum is right; any other
stays as it is. A mention's canonical form drops case and separators where they carry no meaning, so all
spellings of an entity share one surrogate. A surrogate is derived from an HMAC-SHA-512, under the caller's key, of
(kind, canonical form, attempt) and keeps the type and format: digits stay digits, letters stay letters of their script and case, separators
stay, cards keep their first digit and a valid Luhn digit, phones their country code (ten digits without one count as +1), mails their top-level domain,
names their title, gender, script and number of words.

A titled name is all of its initials and capitalised words (particles such as "van der" between them included) up to the
next other word, an assigned secret all of its characters; neither has a length limit. Names do not run over a line end.

Collision check, over all entities of the corpus: every surrogate must belong to one entity and must not be an entity
that really occurs. The first owner (lowest attempt, then canonical form) keeps it, the others draw again, round by
round, until none is left; from the eighth attempt on free-form kinds, phones and IPv6 addresses grow, so the rounds end.

Only texts with an entity are shuffled, once per distinct text: mentions are taken from distinct texts (combined before
the shuffle), surrogates are joined to mentions, and texts are put together again from the pieces between mentions.
Copies of one text are a hot key of the last join alone, which AQE splits.

Defined cases: null text stays null with no entities; texts without an entity stay byte for byte; repeated rows give
repeated rows; an empty table gives an empty result; extra columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEY_SETTING = "spark.lumenstep.surrogates.key"
#: For tests and measurements only, where KEY_SETTING is unset: it is public, so surrogates under it can be guessed.
EVALUATION_KEY = "evaluation only"
MOST_ROUNDS = 40
# Titles that tell gender, and name parts by script.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н", "Κύριος", "Κος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "г-жа", "Κυρία", "Κα")
_LATIN = "bal bel dor fen gar hal jor kel lin mar nor pel ran sol tam ver".split()
_CYRILLIC = "бал бел дор фен гар хал жор кел лин мар нор пел ран сол там вер".split()
_GREEK = "βαλ βελ δορ φεν γαρ χαλ ζορ κελ λιν μαρ νορ πελ ραν σολ ταμ βερ".split()
_ENDS = {("L", "m"): "on er ik us", ("L", "f"): "a ina elle ia", ("C", "m"): "ов ин ик ан", ("C", "f"): "ова ина ика ана", ("G", "m"): "ος ης ας ων", ("G", "f"): "α η ου ια"}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLES = "|".join((*MALE, *FEMALE))
# A name: words with initials, particles or degrees before them, and a last initial. Possessive, so that no long run recurses.
_BEFORE = r"(?:Dr|Prof|St)\. |\p{Lu}\.[ -]?|\p{Lu} (?=\p{Lu})|(?:v[oa]n(?: de[rnm]?)?|vom|zu|de(?: l[ao]s?)?|del|della|di|da|do|dos|du|ter|ten|bin|ben|ibn|al|el) |[dl]['’]"
_WORD = rf"(?:{_BEFORE})*+\p{{Lu}}[\p{{L}}\p{{M}}'’-]+"
_NAME = rf"{_WORD}(?: (?!(?:{_TITLES})(?!\p{{L}})){_WORD})*+(?: (?!I(?!\p{{L}}))\p{{Lu}}(?![\p{{L}}\p{{N}}'’-]))?"
_SECRET = r"(?i:password|passwd|pwd|secret|token|api_?key)[\"']? ?[=:] ?[\"']?"
_NUMBERS = [
    rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\d)",
    r"(?<![\w+(])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)",
    r"(?<![\w.])\d{3}-\d{2}-\d{4}(?![\w-])",
    r"(?<![\w.-])(?:\d{4}[ -]){3}\d{4}(?![\w-])|(?<![\w.-])\d{13,19}(?!\w)",
]
_SIX = r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"
_CAPITALS = [
    r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    r"(?<!\w)A[KS]IA[0-9A-Z]{16}(?!\w)",
    rf"(?<!\w)(?:{_TITLES})\.? {_NAME}",
]
#: Each group of alternatives begins with a look at one character, which settles most places of a text.
PATTERN = "|".join(
    [
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])",
        f"(?=[0-9A-Fa-f]{{1,4}}:){_SIX}",
        f"(?=[0-9+(])(?:{'|'.join(_NUMBERS)})",
        f"(?=[A-ZгΚ])(?:{'|'.join(_CAPITALS)})",
        rf"(?=[pstaPSTA])(?<![A-Za-z]){_SECRET}[A-Za-z0-9+/_.-]{{8,}}(?<=[A-Za-z0-9+/_-])",
    ]
)
#: Every entity but names, some keys and some secrets has a digit or an @: one character class settles most texts without one.
_SOME = r"[0-9@]"


def has_entity(text: Column) -> Column:
    """Whether a text has an entity; cheap looks come before the pattern."""
    maybe = text.rlike(_SOME) | text.contains("AKIA") | text.contains("ASIA")
    for word in (*MALE, *FEMALE):
        maybe = maybe | text.contains(word + " ") | text.contains(word + ". ")
    labelled = text.rlike("[=:]") & text.rlike(_SECRET)
    return F.coalesce((maybe | labelled) & text.rlike(PATTERN), F.lit(False))


#: The kind of a number that isn't a card.
NO_ENTITY = "number"


def luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, its last digit not doubled, modulo 10."""
    each = F.split(F.reverse(digits), "")
    value = F.transform(each, lambda x, k: F.when(x == "", 0).when(k % 2 == 0, x.cast("int")).otherwise(2 * x.cast("int") - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def key_of(spark: SparkSession) -> str:
    """The session's secret key, or the evaluation key where none is set."""
    return spark.conf.get(KEY_SETTING, None) or EVALUATION_KEY


def hmac_sql(key: str, message: str) -> str:
    """HMAC-SHA-512 (RFC 2104) of a string expression, as hex digits."""
    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner, outer = (bytes(b ^ pad for b in raw).hex() for pad in (0x36, 0x5C))
    return f"sha2(concat(X'{outer}', unhex(sha2(concat(X'{inner}', cast({message} as binary)), 512))), 512)"


def kind_of(e: Column) -> Column:
    """The type of a mention."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    return (
        F.when(e.contains("@"), "email")
        .when(e.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^(\+|\(\d{3}\)|\d{3}[.-]\d{3}[ .-]\d{4}$)"), "phone")
        .when(e.rlike(r"^[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]+$"), "ip6")
        .when(e.rlike(r"^\d{13,19}$") & (luhn(digits) != 0), NO_ENTITY)
        .when(e.rlike(r"^[\d -]+$") & (F.length(digits) >= 13), "card")
        .when(e.rlike(rf"^(?:{_TITLES})\.? "), F.when(e.rlike(rf"^(?:{'|'.join(MALE)})\.? "), "name-m").otherwise("name-f"))
        .when(e.rlike(r"^A[KS]IA[0-9A-Z]{16}$"), "key")
        .when(e.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$"), "iban")
        .otherwise("secret")
    )


def canon_of(kind: Column, e: Column) -> Column:
    """The form that all spellings of an entity share."""
    return (
        F.when(kind.isin("email", "ip6"), F.lower(e))
        .when(kind.isin("card", "ssn"), F.regexp_replace(e, "[^0-9]", ""))
        .when(kind == "phone", F.regexp_replace(F.regexp_replace(e, "[^0-9+]", ""), r"^(?=\d{10}$)", "+1"))
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .when(kind == "secret", F.regexp_replace(e, "^" + _SECRET, ""))
        .when(kind.startswith("name"), F.lower(F.trim(F.regexp_replace(F.regexp_replace(e, r"^\S+ ", ""), r"\.[ -]?", " "))))
        .otherwise(e)
    )


# The expressions below read the columns kind, canon, attempt and hx (hex digits of the keyed hash).
def _byte(i: str) -> str:
    return f"cast(conv(substring(hx, 2 * (({i} - 1) % 128) + 1, 2), 16, 10) as int)"


def _pick(alphabet: str, i: str) -> str:
    return f"substring('{alphabet}', {_byte(i)} % {len(alphabet)} + 1, 1)"


def _shape(src: str) -> str:
    """Letters to letters of the same script and case, digits to digits; hexadecimal strings stay hexadecimal."""
    low, greek, cyr = "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщыэюя"
    i = "(k + 1)"  # one pass over the characters: a secret may be long
    return (
        f"element_at(transform(array({src} rlike '^[0-9a-f]+$'), hex -> array_join(transform(regexp_extract_all({src}, '(?s).', 0), (c, k) -> case "
        f"when hex then {_pick('0123456789abcdef', i)} "
        f"when c rlike '[0-9]' then {_pick('0123456789', i)} "
        f"when c rlike '[a-z]' then {_pick(low, i)} when c rlike '[A-Z]' then {_pick(low.upper(), i)} "
        f"when c rlike '[α-ω]' then {_pick(greek, i)} when c rlike '[а-я]' then {_pick(cyr, i)} "
        f"else c end), '')), 1)"
    )


def _digits(n: str, first: str) -> str:
    """n digits, the first one given."""
    return f"concat({first}, case when {n} > 1 then array_join(transform(sequence(2, greatest(2, {n})), i -> {_pick('0123456789', 'i')}), '') else '' end)"


def _luhn(src: str) -> str:
    """The Luhn sum of a digit string, its last digit not doubled, modulo 10."""
    d = f"coalesce(try_cast(substring({src}, length({src}) + 1 - i, 1) as int), 0)"
    return f"(aggregate(transform(sequence(1, length({src})), i -> case when i % 2 = 1 then {d} else cast((2 * {d}) div 10 + (2 * {d}) % 10 as int) end), 0, (a, x) -> a + x) % 10)"


def _name() -> str:
    def of(parts: list[str], script: str) -> str:
        lists = {g: _ENDS[script, g].split() for g in "mf"}
        syllable = lambda i: f"element_at(array({', '.join(repr(p) for p in parts)}), {_byte(i)} % {len(parts)} + 1)"
        end = {g: f"element_at(array({', '.join(repr(p) for p in x)}), {_byte('(4 + 7 * k)')} % {len(x)} + 1)" for g, x in lists.items()}
        extra = f"array_join(transform(sequence(1, attempt + 1), i -> case when i > 1 then {syllable('i + 4')} else '' end), '')"
        word = f"concat({syllable('(1 + 7 * k)')}, {syllable('(2 + 7 * k)')}, case when k = 0 then {extra} else '' end, case when kind = 'name-m' then {end['m']} else {end['f']} end)"
        letter = _pick("".join(sorted({p[0] for p in parts})), "(1 + 7 * k)")
        # single letters are initials; the first word grows with the attempts, or stands before a name that starts with an initial
        grown = f"case when k = 0 and attempt >= 4 then concat({word}, ' ', {letter}) else {letter} end"
        return f"array_join(transform(split(canon, ' '), (w, k) -> case when length(w) = 1 then {grown} else {word} end), ' ')"

    return f"case when canon rlike '[а-я]' then {of(_CYRILLIC, 'C')} when canon rlike '[α-ω]' then {of(_GREEK, 'G')} else {of(_LATIN, 'L')} end"


def surrogate(key: str) -> Column:
    """The canonical surrogate of (kind, canon, attempt)."""
    grown = "case when attempt >= 8 then array_join(transform(sequence(8, attempt), i -> " + _pick("abcdefghijklmnopqrstuvwxyz", "i + 100") + "), '') else '' end"
    country = r"case when canon like '+1%' then '+1' when canon like '+%' then substring(canon, 1, 3) else '' end"
    n = f"(length(canon) - length({country}))"
    more = "greatest(0, attempt - 7)"
    hexes = f"array_join(transform(regexp_extract_all(canon, '(?s).', 0), (c, k) -> case when c = ':' then c else {_pick('0123456789abcdef', '(k + 1)')} end), '')"
    group = f"case when attempt >= 8 then concat(':', array_join(transform(sequence(1, 4), i -> {_pick('0123456789abcdef', '(i + 100)')}), '')) else '' end"
    body = _digits("length(canon) - 1", "substring(canon, 1, 1)")
    check = f"cast((10 - {_luhn('concat(body, ' + repr('0') + ')')}) % 10 as string)"
    kinds = f"""case kind
        when 'email' then concat(split(shaped, '@')[0], {grown}, '@', regexp_replace(split(shaped, '@')[1], '[^.]+$', ''), regexp_extract(canon, '[^.]+$', 0))
        when 'ip' then array_join(transform(sequence(1, 4), i -> cast({_byte('i')} % 254 + 1 as string)), '.')
        when 'phone' then concat({country}, {_digits(f"({n} + {more})", f"cast({_byte('1')} % 8 + 2 as string)")})
        when 'ip6' then concat({hexes}, {group})
        when 'card' then concat(body, case when {_luhn('canon')} = 0 then {check} else {_pick('0123456789', '100')} end)
        when 'ssn' then {_digits('9', f"cast({_byte('1')} % 9 + 1 as string)")}
        when 'iban' then concat(substring(canon, 1, 2), substring(shaped, 3))
        when 'key' then concat(substring(canon, 1, 4), substring(shaped, 5))
        when 'name-m' then {_name()}
        when 'name-f' then {_name()}
        else concat(shaped, {grown}) end"""
    message = "concat_ws('|', kind, canon, cast(attempt as string){})"
    hashed = f"concat({hmac_sql(key, message.format(''))}, {hmac_sql(key, message.format(", 'more'"))})"
    # lambdas over one-element arrays name the steps: hash, shape, card body
    inner = f"element_at(transform(array({_shape('canon')}), shaped -> element_at(transform(array({body}), body -> {kinds}), 1)), 1)"
    return F.expr(f"element_at(transform(array({hashed}), hx -> {inner}), 1)")


def laid_out() -> Column:
    """A canonical surrogate `sur` in the format of the mention `e` of the kind."""
    fill = (
        "array_join(transform(sequence(1, length(e)), i -> case when substring(e, i, 1) rlike '[0-9]' then "
        "substring(ds, length(regexp_replace(substring(e, 1, i), '[^0-9]', '')), 1) else substring(e, i, 1) end), '')"
    )
    spaced = (
        "array_join(transform(sequence(1, length(e)), i -> case when substring(e, i, 1) <> ' ' then "
        "substring(sur, length(replace(substring(e, 1, i), ' ', '')), 1) else ' ' end), '')"
    )
    cased = (
        "case when length(e) = length(sur) then array_join(transform(sequence(1, length(e)), i -> case when substring(e, i, 1) rlike '[A-Z]' "
        "then upper(substring(sur, i, 1)) else substring(sur, i, 1) end), '') else sur end"
    )
    return F.expr(
        f"""case when kind in ('card', 'ssn', 'phone') then element_at(transform(array(regexp_replace(regexp_replace(sur, case when e like '+%' then '^$' else '^[+]1' end, ''), '[^0-9]', '')), ds -> concat({fill}, substring(ds, length(regexp_replace(e, '[^0-9]', '')) + 1))), 1)
        when kind = 'iban' then {spaced} when kind in ('email', 'ip6') then {cased}
        when kind like 'name%' then concat(regexp_extract(e, '^(\\\\S+ )', 1), case when e rlike '(^| |[.]|-)\\\\p{{Lu}}[.]' then regexp_replace(initcap(sur), '(?<=^| )(\\\\p{{Lu}})(?= )', '$1.') else initcap(sur) end)
        when kind = 'secret' then concat(substring(e, 1, length(e) - length(canon)), sur) else sur end"""
    )


def settle(entities: DataFrame, key: str, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(kind, canon, sur) with distinct surrogates that are no entity themselves. entities: distinct (kind, canon)."""
    real = common.cut(entities)
    now = real.withColumn("attempt", F.lit(0)).withColumn("sur", surrogate(key))
    for _ in range(most_rounds):
        owners = now.groupBy("kind", "sur").agg(F.min(F.struct("attempt", "canon")).alias("owner"))
        taken = real.select("kind", F.col("canon").alias("sur"), F.lit(True).alias("real"))
        judged = now.join(owners, ["kind", "sur"]).join(taken, ["kind", "sur"], "left")
        lost = (F.col("owner.canon") != F.col("canon")) | F.col("real").isNotNull()
        judged = common.cut(judged.select("kind", "canon", "attempt", "sur", lost.alias("lost")))
        if judged.where("lost").isEmpty():
            return judged.select("kind", "canon", "sur")
        again = judged.select("kind", "canon", (F.col("attempt") + F.col("lost").cast("int")).alias("attempt"))
        now = again.withColumn("sur", surrogate(key))
    raise RuntimeError("surrogates did not settle: the space of a kind is too small for its entities")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with the text's entities replaced under a secret key; count_col adds the number of mentions."""
    if not key:
        raise ValueError("a secret key is needed")
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs[text_col].alias("text"))
    has = has_entity(F.col("text"))
    mine = rows.where(has).select("row", "text", F.sha2("text", 256).alias("key"))
    pattern = F.lit(PATTERN)
    texts = mine.select("key", F.regexp_extract_all("text", pattern, F.lit(0)).alias("found")).groupBy("key").agg(F.first("found").alias("found"))
    mentions = texts.select("key", F.posexplode("found").alias("at", "e"))
    mentions = mentions.withColumn("kind", kind_of(F.col("e")))
    mentions = mentions.withColumn("canon", canon_of(F.col("kind"), F.col("e")))
    mentions = common.written(mentions, "mentions")
    real = mentions.where(F.col("kind") != NO_ENTITY)
    table = settle(real.select("kind", "canon").distinct(), key)
    placed = real.join(table, ["kind", "canon"]).select("key", "at", laid_out().alias("new"), F.lit(1).alias("n"))
    placed = placed.unionByName(mentions.where(F.col("kind") == NO_ENTITY).select("key", "at", F.col("e").alias("new"), F.lit(0).alias("n")))
    lists = placed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("news"), F.sum("n").cast("int").alias("n"))
    lists = lists.select(F.col("key").alias("text_key"), F.col("news.new").alias("news"), "n")
    joined = mine.join(lists, F.col("key") == F.col("text_key"))
    gaps = F.split("text", PATTERN, -1)
    text = F.array_join(F.zip_with(gaps, F.concat("news", F.array(F.lit(""))), lambda g, s: F.concat(g, s)), "")
    done = joined.select("row", text.alias("new_text"), "n")
    plain = rows.where(~has).select("row", F.col("text").alias("new_text"), F.lit(0).alias("n"))
    out = done.unionByName(plain)
    cols = [F.col("new_text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names]
    return out.select(*cols, *([F.col("n").alias(count_col)] if count_col else []))
