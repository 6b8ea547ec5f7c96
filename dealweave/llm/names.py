"""How typed names are brought to comparable tokens; shared by the operators that match names."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

#: Letters that have no decomposition, legal forms, and short forms of given names.
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h"})
LEGAL = frozenset("inc llc lp llp ltd limited plc corp corporation co company gmbh ag kg sa sas sarl bv nv ab oy as spa srl pty pte holdings holding group us usa uk eu".split())
ARTICLES = frozenset("the a an and".split())
SHORT_NAMES = {
    short: full
    for full, shorts in {
        "abigail": "abby gail", "abraham": "abe", "albert": "al bert", "alexander": "alex sandy", "alfred": "alf fred", "amanda": "mandy", "andrew": "andy drew",
        "anthony": "tony", "arthur": "art artie", "barbara": "barb babs", "benjamin": "ben benny", "bernard": "bernie", "catherine": "cathy", "charles": "charlie chuck chas",
        "christine": "chrissy tina", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "dorothy": "dot dolly",
        "edward": "ed eddie ned ted", "eleanor": "ellie nell nora", "elizabeth": "liz beth betty eliza lizzie", "emily": "em emmy", "eugenia": "zhenya", "florence": "flo",
        "frances": "fran francie", "francis": "frank", "francisco": "paco pancho", "frederick": "freddie freddy", "gabriel": "gabe", "george": "georgie", "gerald": "gerry jerry",
        "gilbert": "gil", "giuseppe": "beppe peppe", "gregory": "greg", "harold": "hal", "helen": "nellie", "henrietta": "hetty etta hattie", "henry": "hank harry",
        "isabella": "izzy bella", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny", "jessica": "jess jessie", "johann": "hans", "john": "jack johnny",
        "jonathan": "jon", "joseph": "joe joey", "joshua": "josh", "judith": "judy", "katherine": "kate katie kathy kay", "kenneth": "ken kenny", "lawrence": "larry lars",
        "leonard": "len lenny", "leopold": "leo", "lillian": "lily lil", "louis": "lou", "madeleine": "maddy", "margaret": "maggie meg peggy greta", "martha": "marty",
        "matthew": "matt", "maximilian": "max", "michael": "mike mick mickey", "mildred": "millie", "nathaniel": "nate nat", "nicholas": "nick nicky", "oliver": "ollie",
        "pamela": "pam", "patricia": "pat patty trish", "peter": "pete", "philip": "phil pip", "raymond": "ray", "rebecca": "becky", "reginald": "reg reggie",
        "richard": "rick dick ricky", "robert": "rob bob bobby robbie", "ronald": "ron ronnie", "rudolf": "rudi", "samuel": "sam sammy", "sarah": "sally sadie",
        "sebastian": "seb bastian", "stephen": "steve", "susannah": "sue susie suzy", "theodore": "theo", "theresa": "tess tessa", "thomas": "tom tommy", "timothy": "tim",
        "valentina": "val", "victoria": "vicky tori", "vincent": "vince", "virginia": "ginny", "walter": "walt wally", "wilhelmina": "mina", "william": "will bill billy willy",
        "zachary": "zach zack",
    }.items()
    for short in shorts.split()
}
_NUMERAL = re.compile(r"^(?:[ivx]{1,5}|\d{1,4})$")


def folded(text: str) -> str:
    """Lower case, without accents."""
    t = unicodedata.normalize("NFKD", text.lower().translate(_LETTERS))
    return "".join(c for c in t if not unicodedata.combining(c))


LONG_WORD, MANY_WORDS = 64, 40


def _hashed(text: str) -> str:
    return text[:8] + hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=12).hexdigest()


def tokens(name: str) -> list[str]:
    """The words of a name: folded, without what stands in brackets at its end, legal forms and articles (unless nothing else is left).

    A word of more than LONG_WORD letters is told by its beginning and a hash of it; so is, as one word, a name of more than MANY_WORDS words.
    """
    t = re.sub(r"\s*\([^()]*\)\s*$", "", name.strip()) or name
    t = folded(re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z][^\W\d_A-Z])", " ", t))  # a capital inside a word begins another
    t = re.sub(r"(?<=\w)[’'](?=\w)", "", t)
    t = re.sub(r"\b(?:[a-z]\.){2,}", lambda m: m.group().replace(".", ""), t)  # S.A. is one word
    words = [w if len(w) <= LONG_WORD else _hashed(w) for w in re.findall(r"\w+", t)]
    if len(words) > MANY_WORDS:
        return [_hashed(" ".join(words))]
    kept = [w for w in words if w not in LEGAL and w not in ARTICLES]
    return kept or words


def numerals(words: list[str]) -> str:
    """The numbers in a name, which tell the funds of one house apart; a single letter is an initial, not a number."""
    return " ".join(sorted(w for w in words if _NUMERAL.match(w) and (len(w) > 1 or w.isdigit())))


def skeleton(word: str) -> str:
    """The first letter and the following consonants, doubles once."""
    out = word[:1]
    for c in word[1:]:
        if c not in "aeiouy" and c != out[-1]:
            out += c
    return out


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between a and b, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


@lru_cache(maxsize=200_000)
def alike(a: str, b: str) -> float:
    """How alike two words are: 1 if equal, less for typing errors, short forms, abbreviations and initials, 0 if unlike."""
    if a == b:
        return 1.0
    x, y = SHORT_NAMES.get(a, a), SHORT_NAMES.get(b, b)
    if x == y:
        return 0.95
    if len(a) > len(b):
        a, b, x, y = b, a, y, x
    if a[-1:] == "y" and b == a[:-1] + "ies":
        return 0.95
    if len(a) == 1:
        return 0.8 if a in (b[0], y[0]) else 0.0
    if a[0] == b[0] and (b.startswith(a) or (not set(a[1:]) & set("aeiou") and _within(a, b))):
        return 0.85
    n = len(b)
    if n >= 4:
        most = 1 if n < 7 else 2
        if (d := edits(a, b, most)) <= most:
            return 1.0 - d / max(n, 6)
    return 0.0


def _within(a: str, b: str) -> bool:
    it = iter(b)
    return all(c in it for c in a)


def similarity(a: list[str], b: list[str], wa: list[float], wb: list[float]) -> float:
    """Soft weighted cosine of two token lists: each word of one goes with its most alike word of the other."""
    if not a or not b:
        return 0.0
    if "".join(a) == "".join(b):
        return 1.0
    left, right = list(range(len(a))), list(range(len(b)))
    total = matched = 0.0
    pairs = sorted(((alike(x, y), min(wa[i], wb[j]), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), reverse=True)
    for s, w, i, j in pairs:
        if s > 0 and i in left and j in right:
            left.remove(i)
            right.remove(j)
            # A mistyped word is rarer than the word that is meant: it weighs what the other weighs.
            total += s * w * w
            matched += w * w
    _drop_acronym(a, left, b, right)
    _drop_acronym(b, right, a, left)
    rest_a, rest_b = sum(wa[i] ** 2 for i in left), sum(wb[j] ** 2 for j in right)
    if left and right:  # each says something that the other doesn't
        total -= 2.0 * min(max(wa[i] for i in left), max(wb[j] for j in right)) ** 2
    return total / max(((matched + rest_a) * (matched + rest_b)) ** 0.5, 1e-9)


def _drop_acronym(a: list[str], left: list[int], b: list[str], right: list[int]) -> None:
    """Takes away a word of a that is the initials of words of b, and these."""
    initials = "".join(b[j][0] for j in right)
    for i in left:
        at = initials.find(a[i]) if 2 <= len(a[i]) <= 5 else -1
        if at >= 0:
            left.remove(i)
            del right[at : at + len(a[i])]
            return


#: What firms of any name call themselves, and letters they write for it.
GENERIC = (
    "partners capital ventures investments investors equity equities growth angels seed fund funds finance financial management advisors associates trust bank "
    "systems technologies technology tech energy labs laboratories robotics software health healthcare networks solutions services industries international digital "
    "media studios games analytics data security consulting logistics pharma therapeutics biotech sciences ai io vc sf"
).split()
_BY_LETTER = {g[0]: [x for x in GENERIC if x[0] == g[0]] for g in GENERIC}


@lru_cache(maxsize=100_000)
def generic(word: str) -> bool:
    """Whether a word is one that firms of any name have, written out, in the singular, cut short, without vowels, or with x for cs."""
    w = word[:-1] + "cs" if word.endswith("x") else word
    for g in _BY_LETTER.get(w[:1], ()):
        if w == g or w + "s" == g or len(w) >= 2 and len(w) < len(g) and (len(w) >= 3 and g.startswith(w) or not set(w[1:]) & set("aeiou") and _within(w, g)):
            return True
    return False


class Key(NamedTuple):
    """What is compared of a name: the skeleton of its main word, the first letters of its other words, its numbers, and the main word itself."""

    core: str
    initials: str
    numbers: str
    word: str


def key(name: str) -> Key | None:
    """The key of a name across spellings: the main word is the longest; short forms of given names stand for the full ones.

    Generic words are left out unless nothing else is left; a name without any word has no key.
    """
    return _key(tokens(name))


def _key(words: list[str]) -> Key | None:
    nums = numerals(words)
    named = [w for w in words if not _NUMERAL.match(w) or len(w) == 1 and not w.isdigit()]
    own = sorted({SHORT_NAMES.get(w, w) for w in named if not generic(w)} or set(named), key=lambda w: (-len(w), w))
    if not own:
        return Key(nums, "", "", nums) if nums else None
    return Key(skeleton(own[0]), "".join(sorted({w[0] for w in own[1:]})), nums, own[0])


def core(name: str) -> str:
    """The key of a name as one string."""
    return core_of(tokens(name))


def core_of(words: list[str]) -> str:
    """The key of a name's words as one string."""
    k = _key(words)
    return f"{k.core}{k.initials}{f' {k.numbers}' if k.numbers else ''}" if k else ""
