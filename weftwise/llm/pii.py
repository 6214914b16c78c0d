"""Surrogates for personal data, all in DataFrame expressions.

Entities found: e-mail addresses, phone, card, bank account and social security numbers, IP addresses (both versions), access
tokens, and names behind a form of address. Each is replaced by a keyed surrogate of its own kind: same length
and separators, digits for digits and letters for letters of the same case, country codes and top-level domains
kept, cards that pass the Luhn check and bank accounts that pass theirs if the original does (numbers grow by a
digit a round where all of a length are taken), private, loopback and link-local IP ranges that stay so (or go to
a wider private or the reserved range where one is full), given names of the same gender and surnames in the same
script, with their hyphens and apostrophes. One entity has one surrogate in the whole table however it is written
(coreference), two entities never share one, and none is another's original (collision checks). What entities share is
an entity of its own: an e-mail's domain, so addresses of one house stay in one; a surname, so it stays the same alone
and in a full name; and a given name, so titles don't part a person. A given name's gender is what all its titles in the
table say (``Dr`` says nothing; where titles differ, it gets a neutral name).

1. The distinct entities of all texts are collected as narrow rows (aggregated before the shuffle).
2. Each gets a surrogate for round 0. Those whose surrogate another entity has, or which is an entity itself,
   go to the next round, until none is left; domains first, as addresses hold them. Who keeps a surrogate is the
   least of those that have it, an aggregate: nothing is sorted within a surrogate, however many share it.
   Only entities past round 0, and given names whose titles differ, need to be looked up later.
3. Texts are cut at their entities and joined again with surrogates computed in place. If few entities have to be
   looked up (``LOOKUP_ROWS`` at most, a checked size) they ride along as a literal; otherwise the texts
   that hold any are joined with them.

A name is a form of address, or several, and one or two capitalised words, with initials, particles (von, de) and a
second surname behind a hyphen. Words that open sentences (``NOT_NAMES``) are no names, so "Mr Smith Yesterday" is
Mr Smith; behind a single name any other capitalised word counts as the surname. Names without a form of address stay.

Nulls stay null; empty texts and texts without entities come out byte for byte; very long texts are replaced whole;
repeated rows come out alike; an empty table stays one; other columns pass. Without the key surrogates can't be
recomputed; the key is a parameter and isn't stored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwise.llm.common import drop_path, free_name, materialise, row_key, work_dir
from weftwise.llm.quality import let

LOOKUP_ROWS = 2000
#: From this round on a surrogate leaves a space that has run out: numbers get longer, private addresses go to a wider range.
WIDER = 6
#: Rounds in which a given name is one of its list; each round after them adds a syllable.
PLAIN_GIVEN = 3

# Forms of address by gender, and given names by script and gender.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа", "Κυρία"], "n": ["Dr", "Prof", "Mx"]}
GIVEN = {
    "latin": {"m": ["Adam", "Bruno", "Conrad", "Edgar", "Felix", "Hugo", "Leon", "Oscar"], "f": ["Alma", "Clara", "Edith", "Flora", "Ida", "Laura", "Nora", "Vera"], "n": ["Alex", "Kim", "Robin", "Sascha"]},
    "cyrillic": {"m": ["Антон", "Борис", "Глеб", "Павел"], "f": ["Анна", "Вера", "Лидия", "Ольга"], "n": ["Саша", "Женя"]},
    "greek": {"m": ["Νίκος", "Πέτρος", "Γιώργος"], "f": ["Ελένη", "Μαρία", "Σοφία"], "n": ["Αλέξης"]},
}
SYLLABLES = {
    "latin": "bar ben bor dal den dor fal fen gar hol kal kem lan lor mar mel nor pel ran sel tam tor val wen".split(),
    "cyrillic": "бар вел гор дан зор кал лен мир нов рад сев тар".split(),
    "greek": "βαρ γελ δαν ζορ καλ λεν μαρ νικ παλ ραν σελ ταρ".split(),
}

# Country calling codes; all others have three digits.
_COUNTRY = r"^\+(?:1|7|20|27|3[0-4]|36|39|40|41|4[3-9]|5[1-8]|6[0-6]|81|82|84|86|9[0-5]|98|\d{3})"

#: Words that stand in a name without being replaced.
PARTICLES = "von van vom zu zur der den de del della di da dos du la le ten ter al el bin ibn".split()
# Capitalised words that open a sentence or name a day, month or language, in the languages of the titles.
NOT_NAMES = """
A About According After Again All Also Although Always An And Another Any Are As At Because Before Both But By Can Could Did Do Does During Each Even Every Finally First For From Had Has Have He Her Here His How However I If In
Is It Its Just Last Later Let Many May Maybe Might More Most Much My Never Next No Nobody Not Nothing Now Of Often On Once One Only Or Our Perhaps Please Several She Should Since So Some Sometimes Soon Still Such Than Thank That The Their Then There
These They This Those Though Thus To Today Tomorrow Tonight Two Under Until Was We Well Were What When Where Which While Who Why Will With Without Would Yes Yesterday Yet You Your
Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September October November December English German French Spanish
Aber Alle Als Also Am An Auch Auf Aus Bei Bis Da Dann Das Dass Der Die Dies Diese Dort Ein Eine Er Es Gestern Hat Heute Hier Ich Ihr Im In Ist Ja Jetzt Kein Man Mit Morgen Nach Nein Nicht Noch Nun Nur Oder Ohne Seit Sie Sind So Und Unser Vom Von Vor Wann War Warum Was Wenn Wer
Wie Wir Wo Zu Zum Zur Alors Après Au Aujourd Avec Ce Cependant Ces Cette Dans De Demain Depuis Des Donc Du Elle Elles En Est Et Hier Il Ils Je La Le Les Leur Mais Ne Nous On Ou Par Pour Puis Quand Que Qui Sa Sans Ses Si Sur Tous Un Une Vous
Ahora Ante Así Aunque Ayer Como Con Cuando Desde Después Donde El Ella Ellos Era Esta Este Esto Fue Hoy Las Los Luego Mañana Más Mi Muy No Nos Para Pero Por Porque Pues Se Según Sin Su También Todo Una Y Ya Yo Он Она Они Но И В На Это Вчера Сегодня Завтра Мы Я Вы Ο Η Το Οι Και Χθες Σήμερα Αύριο
""".split()

_TITLE = "|".join(sorted((x for xs in TITLES.values() for x in xs), key=len, reverse=True))
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_TOKEN = r"(?<!\w)(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|[0-9a-fA-F]{32,128})(?!\w)"
_IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
_IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
_PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w-])\d{3}([-.])\d{3}\1\d{4}(?![\w-])"
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_CARD = r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"
_IP6 = r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}|(?=[A-Fa-f:]*\d)[23fF][0-9A-Fa-f]{3}:(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"
_NO = rf"(?!(?:{'|'.join(dict.fromkeys(NOT_NAMES))})(?![\p{{L}}'’-]))"
#: A capitalised word with the parts behind hyphens and apostrophes, but not a possessive s.
_WORD = rf"{_NO}\p{{Lu}}(?=\p{{L}}|['’-]\p{{L}})\p{{L}}*(?:['’-](?!s(?!\p{{L}}))\p{{L}}+)*"
_BEFORE = rf"(?:(?:{'|'.join(PARTICLES)}|\p{{Lu}}\.) )*"
_TITLES = rf"(?:(?:{_TITLE})\.? )+"
_NAME = rf"(?<![\p{{L}}\d]){_TITLES}{_BEFORE}{_WORD}(?: {_BEFORE}{_WORD})?"
_PHONE = r"(?<![\w+])00[1-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|" + _PHONE
_PHONE = _PHONE.replace(r"([-.])", r"(?:-|\.)").replace(r"\1", r"(?:-|\.)")
ENTITY = "|".join([_EMAIL, _TOKEN, _IBAN, _IP6, _IP, _PHONE, _SSN, _CARD, _NAME])
#: Without one of these a text has no entity.
_GATE = rf"[0-9@]|AKIA|gh[pousr]_|sk-|[a-fA-F]{{32}}|(?:{_TITLE})"


def kind_of(match: Column) -> Column:
    whole = lambda p: match.rlike(f"^(?:{p})$")
    return (
        F.when(match.contains("@"), "email").when(match.rlike(rf"^(?:{_TITLE})\b"), "name").when(whole(_TOKEN), "token").when(whole(_IBAN), "iban").when(match.contains(":"), "ipv6")
        .when(whole(_IP), "ip").when(whole(_PHONE), "phone").when(whole(_SSN), "ssn").otherwise("card")
    )


def _titles(match: Column) -> Column:
    return F.regexp_extract(match, rf"^{_TITLES}", 0)


def _name_words(match: Column) -> Column:
    """What stands behind the titles."""
    return F.split(F.substr(match, F.char_length(_titles(match)) + 1), " ")


def _is_name(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}(?!\.)")


def _surname(match: Column) -> Column:
    return F.substring_index(match, " ", -1)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def canonical(kind: Column, match: Column) -> Column:
    """What all spellings of one entity have in common."""
    return (
        F.when(kind.isin("email", "ipv6"), F.lower(match)).when(kind.isin("token", "ip"), match).when(kind == "iban", F.replace(match, F.lit(" "), F.lit("")))
        .when(kind == "name", F.regexp_replace(F.lower(_surname(match)), r"(?<=(?:ов|ев|ин))а$", "")).when(kind == "phone", F.regexp_replace(F.regexp_replace(match, "^00", "+"), r"[^0-9+]", ""))
        .otherwise(F.regexp_replace(match, r"[^0-9]", ""))
    )


def _gender(match: Column) -> Column:
    """Of the first title that tells."""
    titles = _titles(match)
    said = lambda g: F.regexp_instr(titles, F.lit(rf"(?<!\p{{L}})(?:{'|'.join(TITLES[g])})(?!\p{{L}})"))
    m, f = said("m"), said("f")
    return F.when((m > 0) & ((f == 0) | (m < f)), "m").when(f > 0, "f").otherwise("n")


def given_of(kind: Column, match: Column) -> Column:
    """Script and given name of a full name, else null."""

    def first(words: Column) -> Column:
        names = F.filter(words, _is_name)
        word = F.lower(F.get(names, F.lit(0)))
        return F.when(F.size(names) > 1, F.concat_ws("|", _script(word), word))

    return F.when(kind == "name", let(_name_words(match), first))


def domain_of(kind: Column, match: Column) -> Column:
    return F.when(kind == "email", F.lower(F.substring_index(match, "@", -1)))


def _number(hex_: Column, i: Column | int, base: int) -> Column:
    """The i-th number below ``base`` of a hexadecimal stream."""
    at = (F.lit(i) if isinstance(i, int) else i) * 4 + 1
    return F.conv(F.substr(hex_, at.cast("int"), F.lit(4)), 16, 10).cast("int") % base


def _stream(key: str, seed: Column, n: Column) -> Column:
    """At least ``n`` keyed four-digit hexadecimal numbers."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(n / 16).cast("int")), lambda k: F.sha2(F.concat_ws("\x1f", F.lit(key), seed, k.cast("string")), 256)), "")


def _same_classes(text: Column, hex_: Column) -> Column:
    """Digits for digits and letters for letters of the same case; all else stays."""

    def one(c: Column, i: Column) -> Column:
        return (
            F.when(c.rlike("[0-9]"), _number(hex_, i, 10).cast("string")).when(c.rlike("[a-z]"), F.char(F.lit(97) + _number(hex_, i, 26)))
            .when(c.rlike("[A-Z]"), F.char(F.lit(65) + _number(hex_, i, 26))).otherwise(c)
        )

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits."""
    n = F.char_length(digits)

    def part(k: Column) -> Column:
        d = F.substr(digits, (n - k).cast("int"), F.lit(1)).cast("int")
        return F.when(k % 2 == 1, F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, k: s + part(k))


def _remainder(account: Column) -> Column:
    """A string of digits and capitals (A is 10) modulo 97."""
    step = lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.regexp_extract_all(account, F.lit("."), 0), F.lit(0), step)


def _account(canon: Column, body: Column) -> Column:
    """An account of ``canon``'s country over ``body``: its check digits are right if those of ``canon`` are."""
    country = F.substr(canon, F.lit(1), F.lit(2))
    right = _remainder(F.concat(F.substr(canon, F.lit(5)), F.substr(canon, F.lit(1), F.lit(4)))) == 1
    check = 98 - _remainder(F.concat(body, country, F.lit("00"))) - F.when(right, 0).otherwise(1)
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)


def surrogate(key: str, kind: Column, canon: Column, round_: Column, domain_round: Column | None = None, gender: Column | None = None) -> Column:
    """The surrogate of a canonical entity, itself in canonical form.

    ``domain_round`` is the round of an e-mail's domain, ``gender`` that of a given name.
    """
    domain_round = F.lit(0) if domain_round is None else F.coalesce(domain_round, F.lit(0))
    gender = F.lit("n") if gender is None else F.coalesce(gender, F.lit("n"))

    def build(x: Column) -> Column:
        c, h = x["c"], x["h"]
        local, domain = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
        later = F.when(round_ > 0, round_.cast("string")).otherwise("")
        email = F.concat(_same_classes(local, h), later, F.lit("@"), domain_surrogate(key, domain, domain_round))
        prefix = F.regexp_extract(c, r"^(AKIA|gh[pousr]_|sk-|)", 1)
        hexlike = c.rlike("^[0-9a-fA-F]+$")
        lowhex = F.translate(_same_classes(F.lower(c), h), "ghijklmnopqrstuvwxyz", "abcdefabcdefabcdefab")
        token = F.when(hexlike & (F.lower(c) == c), lowhex).when(hexlike, F.upper(lowhex)).otherwise(F.concat(prefix, _same_classes(F.substr(c, F.char_length(prefix) + 1), h)))
        octet = [_number(h, i, 256).cast("string") for i in range(4)]
        ip = (
            F.when(c.startswith("10."), F.concat_ws(".", F.lit("10"), *octet[1:])).when(c.startswith("192.168."), F.concat_ws(".", F.lit("192.168"), *octet[2:]))
            .when(c.startswith("127."), F.concat_ws(".", F.lit("127"), *octet[1:])).when(c.startswith("169.254."), F.concat_ws(".", F.lit("169.254"), *octet[2:]))
            .when(c.rlike(r"^172\.(1[6-9]|2\d|3[01])\."), F.concat_ws(".", F.lit("172"), (16 + _number(h, 1, 16)).cast("string"), *octet[2:]))
            .otherwise(F.concat_ws(".", (11 + _number(h, 0, 100)).cast("string"), *octet[1:]))
        )
        inner = c.rlike(r"^(?:192\.168|169\.254|172\.(?:1[6-9]|2\d|3[01]))\.")
        ip = (
            F.when((round_ >= 2 * WIDER) | ((round_ >= WIDER) & ~inner), F.concat_ws(".", (240 + _number(h, 0, 15)).cast("string"), *octet[1:]))
            .when(round_ >= WIDER, F.concat_ws(".", F.lit("10"), *octet[1:])).otherwise(ip)
        )
        country = F.regexp_extract(c, _COUNTRY, 0)
        # digits beyond the original's length, from their own end of the stream
        longer = F.when(round_ >= WIDER, F.translate(F.substr(F.reverse(h), F.lit(1), (round_ - WIDER + 1).cast("int")), "abcdef", "012345")).otherwise("")
        phone = F.concat(country, _same_classes(F.substr(c, F.char_length(country) + 1), h), longer)
        body = F.concat(F.substr(c, F.lit(1), F.lit(1)), _same_classes(F.substr(c, F.lit(2), F.char_length(c) - 2), h), longer)
        check = let(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10 + F.when(_luhn(c) % 10 == 0, 0).otherwise(1)) % 10).cast("string")))
        iban = let(F.concat(_same_classes(F.substr(c, F.lit(5)), h), longer), lambda b: _account(c, b))
        name = None
        for script, parts in SYLLABLES.items():
            made = _surname_parts(parts, c, h, round_)
            name = F.when(_script(c) == script, made) if name is None else name.when(_script(c) == script, made)
        hexes = lambda at, n: F.array_join(F.transform(F.sequence(F.lit(at), F.lit(at + n - 1)), lambda i: F.lower(F.hex(_number(h, i, 16)))), "")
        groups = F.array_join(F.transform(F.regexp_extract_all(F.substr(c, F.lit(5)), F.lit("."), 0), lambda x, i: F.when(x == ":", x).otherwise(F.lower(F.hex(_number(h, i, 16))))), "")
        start = F.substr(c, F.lit(1), F.lit(4))
        # later rounds take four whole groups, of which there are enough
        ipv6 = F.when(round_ > 2, F.concat(F.when(start.rlike("^f[cde]"), F.regexp_replace(start, ":.*", "")).otherwise("2001"), F.lit("::"), F.concat_ws(":", *[hexes(4 * k, 4) for k in range(4)]))).otherwise(F.concat(start, groups))
        return (
            F.when(kind == "email", email).when(kind == "token", token).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", check)
            .when(kind == "iban", iban).when(kind == "name", F.lower(name)).when(kind == "ipv6", ipv6).otherwise(F.concat(_same_classes(c, h), longer))
        )

    seed = F.concat_ws("\x1f", kind, canon, round_.cast("string"))
    whole = let(F.struct(canon.alias("c"), _stream(key, seed, F.char_length(canon) + 24).alias("h")), build)
    return F.when(kind == "given", given_surrogate(key, canon, round_, gender)).when(kind == "domain", domain_surrogate(key, canon, round_)).otherwise(whole)


def domain_surrogate(key: str, domain: Column, round_: Column) -> Column:
    """Another domain of the same shape under the same last label; later rounds have more letters in front."""

    def build(x: Column) -> Column:
        last = F.substring_index(x["c"], ".", -1)
        host = F.substr(x["c"], F.lit(1), F.char_length(x["c"]) - F.char_length(last))
        more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(x["r"], F.lit(1))), lambda i: F.char(F.lit(97) + _number(F.reverse(x["h"]), i, 26))), "")
        return F.concat(F.when(x["r"] > 0, more).otherwise(""), _same_classes(host, x["h"]), last)

    seed = F.concat_ws("\x1f", F.lit("domain"), domain, round_.cast("string"))
    return let(F.struct(domain.alias("c"), round_.alias("r"), _stream(key, seed, F.char_length(domain) + round_ + 2).alias("h")), build)


def given_surrogate(key: str, canon: Column, round_: Column, gender: Column) -> Column:
    """Another given name of a gender for one of ``given_of``, in the same form: from the list, with syllables in later rounds."""

    def build(x: Column) -> Column:
        out = None
        for script, names in GIVEN.items():
            parts = SYLLABLES[script]
            for g, known in names.items():
                one = F.get(F.lit([n.lower() for n in known]), _number(x["h"], 0, len(known)))
                more = F.transform(F.sequence(F.lit(1), F.greatest(x["r"] - PLAIN_GIVEN + 1, F.lit(1))), lambda i: F.get(F.lit(parts), _number(x["h"], i, len(parts))))  # noqa: B023
                made = F.concat(F.lit(f"{script}|"), one, F.when(x["r"] >= PLAIN_GIVEN, F.concat(F.lit("-"), F.array_join(more, ""))).otherwise(""))
                fits = x["c"].startswith(f"{script}|") & (x["g"] == g)
                out = F.when(fits, made) if out is None else out.when(fits, made)
        return out

    seed = F.concat_ws("\x1f", F.lit("given"), canon, round_.cast("string"))
    return let(F.struct(canon.alias("c"), round_.alias("r"), gender.alias("g"), _stream(key, seed, round_ + 4).alias("h")), build)


def _surname_parts(parts: list[str], canon: Column, hex_: Column, round_: Column) -> Column:
    """Syllables for each part of a surname; what stands between the parts stays."""
    tokens = F.regexp_extract_all(canon, F.lit("[^'’-]+|['’-]"), 0)
    count_ = F.when(F.size(tokens) > 1, 2).otherwise(4) + round_

    def piece(token: Column, at: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), count_ - 1), lambda i: F.get(F.lit(parts), _number(hex_, at + i, len(parts))))
        return F.when(token.rlike("['’-]"), token).otherwise(F.array_join(made, ""))

    return F.array_join(F.transform(tokens, piece), "")


def _capitals(word: Column) -> Column:
    """A lower-case word with each part's first letter capital."""
    return F.array_join(F.transform(F.regexp_extract_all(word, F.lit("[^'’-]+|['’-]"), 0), F.initcap), "")


def _spelt(kind: Column, match: Column, core: Column, given: Column) -> Column:
    """A surrogate in the spelling of the match that it replaces."""
    digits = F.concat(F.when((kind == "phone") & match.startswith("00"), "00").otherwise(""), F.regexp_replace(core, r"[^0-9A-Z]", ""))

    def sign(c: Column, i: Column) -> Column:
        before = F.char_length(F.regexp_replace(F.substr(match, F.lit(1), i.cast("int")), r"[^0-9A-Z]", ""))
        return F.when(c.rlike("[0-9A-Z]"), F.substr(digits, (before + 1).cast("int"), F.lit(1))).otherwise(c)

    spaced = F.array_join(F.transform(F.regexp_extract_all(match, F.lit("(?s)."), 0), sign), "")
    spaced = F.concat(spaced, F.substr(digits, F.char_length(F.regexp_replace(match, r"[^0-9A-Z]", "")) + 1))
    last = _capitals(core)
    last = F.when((_gender(match) == "f") & _surname(match).rlike("(?:ова|ева|ина)$"), F.concat(last, F.lit("ова"))).otherwise(last)
    first = _capitals(F.substring_index(given, "|", -1))

    def word(words: Column) -> Column:
        at = F.array_position(F.transform(words, _is_name), True) - 1
        return F.array_join(F.transform(words, lambda w, i: F.when(i == F.size(words) - 1, last).when((i == at) & given.isNotNull(), first).otherwise(w)), " ")

    name = F.concat(_titles(match), let(_name_words(match), word))
    # an address has the capitals of the original where letters stand for letters
    cased = F.array_join(F.transform(F.split(core, ""), lambda c, i: F.when(F.substr(match, (i + 1).cast("int"), F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    upper = match == F.upper(match)
    return (
        F.when(kind == "name", name).when(kind.isin("phone", "card", "iban", "ssn"), spaced).when(kind.isin("email", "ipv6") & upper, F.upper(core))
        .when((kind == "email") & (match != F.lower(match)) & (F.char_length(core) == F.char_length(match)), cased).otherwise(core)
    )


def mentions(text: Column) -> Column:
    """Every entity in a text, in order."""
    return F.when(text.rlike(_GATE), F.regexp_extract_all(text, F.lit(ENTITY), 0)).otherwise(F.array().cast("array<string>"))


def _entities(found: DataFrame) -> DataFrame:
    """The other columns with (kind, canon, gender) of a column ``m`` of matches; a full name has two rows, and so has an address."""
    kind, m, none = F.col("kind"), F.col("m"), F.lit(None).cast("string")
    row = lambda k, canon, gender=none: F.struct(k.alias("kind"), canon.alias("canon"), gender.alias("gender"))
    own = F.array(row(kind, canonical(kind, m)), row(F.lit("given"), given_of(kind, m), F.when(kind == "name", _gender(m))), row(F.lit("domain"), domain_of(kind, m)))
    others = [c for c in found.columns if c != "m"]
    return found.withColumn("kind", kind_of(m)).select(*others, F.inline(own)).filter("canon is not null")


def one_gender(entities: DataFrame) -> DataFrame:
    """(kind, canon, gender, differs) of distinct (kind, canon, gender): a given name's gender by all its titles."""
    seen = entities.groupBy("kind", "canon").agg(F.collect_set("gender").alias("all"))  # three at most
    told = F.filter("all", lambda g: g != "n")
    return seen.select("kind", "canon", F.when(F.size("all") > 0, F.when(F.size(told) == 1, told[0]).otherwise("n")).alias("gender"), (F.size("all") > 1).alias("differs"))


def later_rounds(entities: DataFrame, key: str, work: str) -> DataFrame:
    """(kind, canon, round, gender) of the entities whose surrogate of round 0 collides; ``entities`` (kind, canon and
    gender, if there are given names) are distinct."""
    whole = entities if "gender" in entities.columns else entities.withColumn("gender", F.lit(None).cast("string"))
    whole = whole.select("kind", "canon", "gender")
    domains = _settled(whole.filter("kind = 'domain'").withColumn("domain_round", F.lit(0)), key, f"{work}/domains")
    rounds = domains.select(F.lit("email").alias("kind"), F.col("canon").alias("domain"), F.col("round").alias("domain_round"))
    rest = whole.filter("kind != 'domain'").withColumn("domain", F.when(F.col("kind") == "email", F.substring_index("canon", "@", -1)))
    rest = rest.join(rounds, ["kind", "domain"], "left").select("kind", "canon", "gender", F.coalesce("domain_round", F.lit(0)).alias("domain_round"))
    return domains.unionByName(_settled(rest, key, f"{work}/others"))


def _settled(entities: DataFrame, key: str, work: str) -> DataFrame:
    """The rounds past 0 of ``entities`` (kind, canon, gender, domain_round)."""
    entities = materialise(entities, f"{work}/entities")
    real = entities.select("kind", F.col("canon").alias("core")).withColumn("real", F.lit(True))
    pending, settled = entities.withColumn("round", F.lit(0)), None
    for r in count():  # every space grows in later rounds, so this ends
        core = surrogate(key, F.col("kind"), F.col("canon"), F.col("round"), F.col("domain_round"), F.col("gender"))
        tried = materialise(pending.withColumn("core", core), f"{work}/tried{r}")
        # the least of those that have it keeps a surrogate
        first = tried.groupBy("kind", "core").agg(F.min(F.struct(F.xxhash64("canon"), "canon")).alias("first")).select("kind", "core", F.col("first.canon").alias("keeps"))
        first = first.join(real, ["kind", "core"], "left_anti")
        if settled is not None:
            first = first.join(settled.select("kind", "core"), ["kind", "core"], "left_anti")
        tried = tried.join(first, ["kind", "core"], "left").withColumn("ok", F.col("canon").eqNullSafe(F.col("keeps"))).drop("keeps")
        tried = materialise(tried.select("kind", "canon", "gender", "domain_round", "round", "core", "ok"), f"{work}/round{r}")
        good = tried.filter("ok").select("kind", "canon", "gender", "round", "core")
        settled = good if settled is None else settled.union(good)
        pending = tried.filter("not ok").select("kind", "canon", "gender", "domain_round", (F.col("round") + 1).alias("round"))
        if pending.isEmpty():
            return settled.filter("round > 0").select("kind", "canon", "round", "gender")


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """``docs`` with surrogates in its text, and ``n_entities`` and ``entity_kinds`` (sorted, distinct) added."""
    spark, work = docs.sparkSession, work_dir(docs.sparkSession)
    text = F.col(text_col)
    found = docs.filter(text.rlike(_GATE)).select(F.explode(F.array_distinct(mentions(text))).alias("m"))
    entities = materialise(one_gender(_entities(found).distinct()), f"{work}/entities")
    later = later_rounds(entities.drop("differs"), key, f"{work}/rounds")
    # of given names whose titles differ the gender has to be looked up as well
    differs = entities.filter("differs").select("kind", "canon", "gender")
    later = later.join(differs.select("kind", "canon"), ["kind", "canon"], "left_anti").unionByName(differs.join(later.select("kind", "canon", "round"), ["kind", "canon"], "left").withColumn("round", F.coalesce("round", F.lit(0))))
    later = materialise(later, f"{work}/later")
    for done in ("entities", "rounds"):
        drop_path(spark, f"{work}/{done}")
    name = {k: free_name(docs, k) for k in ("n_entities", "entity_kinds", "found", "rounds")}
    out = docs.withColumn(name["found"], mentions(text))
    rows = later.limit(lookup_rows + 1).collect()
    known_of: Callable[[Column, Column], Column]
    nothing = F.lit(None).cast("struct<round:int,gender:string>")
    if len(rows) <= lookup_rows:
        pair = lambda r: F.struct(F.lit(r["round"]).alias("round"), F.lit(r["gender"]).cast("string").alias("gender"))
        table = F.create_map(*[x for r in rows for x in (F.lit(f"{r['kind']} {r['canon']}"), pair(r))]) if rows else None
        known_of = lambda kind, canon: F.element_at(table, F.concat_ws(" ", kind, canon)) if rows else nothing
    else:
        _, th = row_key(F.lit(0), text)
        by_text = docs.select(th.alias("th"), F.explode(F.array_distinct(mentions(text))).alias("m"))
        by_text = _entities(by_text).select("th", "kind", "canon").distinct().join(later, ["kind", "canon"])
        by_text = by_text.groupBy("th").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(" ", "kind", "canon").alias("k"), F.struct("round", "gender").alias("v")))).alias(name["rounds"]))
        key_col = free_name(docs, "text_key")
        out = out.withColumn(key_col, th).join(by_text.withColumnRenamed("th", key_col), key_col, "left").drop(key_col)
        known_of = lambda kind, canon: F.element_at(F.col(name["rounds"]), F.concat_ws(" ", kind, canon))

    round_of = lambda kind, canon: F.coalesce(known_of(kind, canon)["round"], F.lit(0))

    def replaced(m: Column) -> Column:
        def known(x: Column) -> Column:
            kind, match = x["kind"], x["m"]
            return let(F.struct(kind.alias("kind"), match.alias("m"), canonical(kind, match).alias("canon"), given_of(kind, match).alias("given"), domain_of(kind, match).alias("domain")), core)

        def core(x: Column) -> Column:
            made = surrogate(key, x["kind"], x["canon"], round_of(x["kind"], x["canon"]), round_of(F.lit("domain"), x["domain"]))
            entry = known_of(F.lit("given"), x["given"])
            given = F.when(x["given"].isNotNull(), given_surrogate(key, x["given"], F.coalesce(entry["round"], F.lit(0)), F.coalesce(entry["gender"], _gender(x["m"]))))
            return let(F.struct(x["kind"].alias("kind"), x["m"].alias("m"), made.alias("core"), given.alias("given")), lambda y: _spelt(y["kind"], y["m"], y["core"], y["given"]))

        return let(F.struct(kind_of(m).alias("kind"), m.alias("m")), known)

    found_col = F.col(name["found"])
    swapped = let(
        F.struct(F.split(text, ENTITY, -1).alias("parts"), F.transform(found_col, replaced).alias("own")),
        lambda x: F.array_join(F.transform(x["parts"], lambda p, i: F.concat(p, F.coalesce(F.get(x["own"], i), F.lit("")))), ""),
    )
    some = F.size(found_col) > 0
    out = out.withColumns({
        name["n_entities"]: F.coalesce(F.size(found_col), F.lit(0)).cast("long"),
        name["entity_kinds"]: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(found_col, kind_of))), ","), F.lit("")),
        text_col: F.when(some, swapped).otherwise(text),
    })
    return out.select(*docs.columns, name["n_entities"], name["entity_kinds"])
