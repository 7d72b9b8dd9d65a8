"""Normal forms of names typed by people; lines of business come from a lexicon learnt from the data."""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass

from tidemark.session import ship

ship(sys.modules[__name__])

# Words that say what legal form a firm has, or decorate its name.
LEGAL = frozenset(
    "inc incorporated incorp llc corp corporation co company ltd limited pbc lp llp plc gmbh ag sa the holdings holding group hq usa us".split()
)
ORG_MARK = frozenset("inc incorporated llc corp corporation ltd lp llp gp fund partners capital trust holdings company".split())
# Short forms of given names.
NICKNAMES = {
    "alexander": "alex sasha xander", "alexandra": "alex sandra", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny",
    "charlotte": "charlie lottie lotte", "christopher": "chris kit topher", "daniel": "dan danny", "deborah": "deb debbie debby", "edward": "ed eddie ted ned",
    "elizabeth": "liz beth betty lizzie eliza lisa", "francisco": "paco pancho fran", "gregory": "greg", "guillermo": "memo", "jennifer": "jen jenny",
    "jonathan": "jon jonny john", "joseph": "joe joey", "jose": "pepe", "katherine": "kate kathy katie kay", "lawrence": "larry lars",
    "margaret": "maggie peggy meg marge", "matthew": "matt", "michael": "mike mick mickey", "muhammad": "mohammed mohamed mohammad muhammed", "nicholas": "nick nicky",
    "patricia": "pat patty trish tricia", "rebecca": "becky becca", "richard": "rick dick rich", "robert": "bob rob bobby robbie bert",
    "samuel": "sam sammy", "stephen": "steve steven", "susan": "sue suzie susie", "theodore": "ted theo teddy", "thomas": "tom tommy",
    "victoria": "vicky tori vicki", "viktor": "victor vik", "william": "bill will billy liam", "yevgenia": "zhenya eugenia evgenia", "zachary": "zach zack zak",
    "xiomara": "xio", "sofia": "sophia sofi", "bjorn": "bjoern", "charles": "charlie chuck", "james": "jim jimmy jamie", "nadia": "nadya", "david": "dave",
}
TITLES = frozenset("jr sr phd md mba esq dr mr mrs ms ii iii iv cpa jd prof".split())
EMPTY = frozenset({"n/a", "na", "none", "nan", "nat", "-", "null", ""})
PARTICLES = frozenset("de la van der von den di da del le".split())

_GIVEN: dict[str, list[str]] = {}
for _k, _v in NICKNAMES.items():
    for _s in [*_v.split(), _k]:
        _GIVEN.setdefault(_s, []).append(_k)


def plain(s: str) -> str:
    """Lower case, accents dropped."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o")


def within_one(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return False
    i = 0
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    if n == m:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < n and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if n > m else a[i:] == b[i + 1 :]


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; most + 1 if it is more than most."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


@dataclass(frozen=True)
class Lexicon:
    """Lines of business, written together, and the line of each form (itself included); see lexicon.py."""

    lines: tuple[str, ...]
    forms: dict[str, str]


NO_LINES = Lexicon((), {})


def business(token: str, lex: Lexicon, last: bool = True) -> str | None:
    """The line of business that a word names, shortened, with one slip, or cut off if it is a name's last word."""
    if token in lex.forms:
        return lex.forms[token]
    if last and len(token) >= 5:
        full = [k for k in lex.lines if k.startswith(token)]
        if len(full) == 1:
            return full[0]
    if len(token) >= 6:
        near = [k for k in lex.lines if len(k) >= 6 and within_one(token, k)]
        if len(near) == 1:
            return near[0]
    return None


_PAREN = re.compile(r"[(\[]\s*(?:us|usa|u\.s\.a?\.?)\s*[)\]]|/[a-z]{2,4}/?\s*$")


def _cleaned(name: str) -> str:
    s = _PAREN.sub(" ", plain(name).strip()).replace("'", "").replace("’", "")
    s = re.sub(r"\bl\.?\s?l\.?\s?c\b\.?", " llc ", s)
    return re.sub(r"\b([a-z])\.\s?([a-z])\.", r" \1\2 ", s)


def name_words(name: str) -> list[str]:
    """The words of an organisation's name without legal forms, unless nothing else is there."""
    tokens = re.findall(r"[a-z0-9]+", _cleaned(name))
    return [t for t in tokens if t not in LEGAL] or tokens


def org_form(name: str | None, lex: Lexicon = NO_LINES) -> tuple[str, str] | None:
    """(core, line of business or ''): the core's words without blanks, the shorter of two first; None if nothing is left."""
    if name is None:
        return None
    s = _cleaned(name)
    by = re.match(r"^(.*)\bby\b(.*)$", s)
    if by and business("".join(re.findall(r"[a-z0-9]+", by.group(1))), lex):
        s = by.group(2) + " " + by.group(1)
    s = re.sub(r"^\s*board of\b", " ", s)
    tokens = re.findall(r"[a-z0-9]+", s)
    kept = [t for t in tokens if t not in LEGAL] or tokens
    if len(kept) > 2 and len(kept[-1]) >= 3 and any(w.startswith(kept[-1]) for w in ("incorporated", "corporation", "limited", "company")):
        kept.pop()
    kind, core, i = "", [], 0
    while i < len(kept):
        two = lex.forms.get("".join(kept[i : i + 2])) if i + 1 < len(kept) else None
        one = business(kept[i], lex, i == len(kept) - 1 and tokens[-1] == kept[i])
        if i == 0 and one and kept[0] not in lex.lines:
            one = None  # a short form doesn't begin a name
        if two and (core or len(kept) > 2):
            kind = kind or two
            i += 2
        elif one and (core or len(kept) > 1):
            kind = kind or one
            i += 1
        else:
            t = kept[i]
            core.append(t.translate(str.maketrans("013457", "oieast")) if re.search("[a-z]", t) else t)
            i += 1
    if not core:
        return None
    if not kind and len(core) == 1 or (not kind and len(core) == 2 and len(core[1]) > 10):
        # a name run together with its line of business
        for k in lex.lines:
            if core[-1].endswith(k) and len(core[-1]) > len(k) + 5 and len(k) > 3:
                core[-1], kind = core[-1][: -len(k)], k
                break
    if len(core) == 2 and (len(core[0]), core[0]) > (len(core[1]), core[1]):
        core.reverse()
    return "".join(core), kind


def is_org(name: str) -> bool:
    toks = re.findall(r"[a-z]+", plain(name).replace(".", ""))
    return len(toks) >= 2 and (any(t in LEGAL and t not in ("the", "us", "co", "sa", "ag") for t in toks) or any(t in ORG_MARK for t in toks))


def person_form(name: str | None) -> tuple[str, ...] | None:
    """Sorted words of a person's name: titles, blanks and placeholders dropped, hyphenated parts kept together."""
    if name is None:
        return None
    s = plain(name)
    s = re.sub(r"\bph\.?\s?d\b\.?", " ", s)
    s = re.sub(r"\bm\.\s?d\.?", " ", s)
    words = [w.strip(".,;\"()") for w in s.replace(",", " , ").split()]
    words = [w for w in words if w not in EMPTY and w not in TITLES and w != ","]
    out, hold = [], []
    for w in words:
        w = re.sub(r"[^a-z0-9-]", "", w)
        if w in PARTICLES:
            hold.append(w)
        elif w:
            out.append("".join(hold) + w)
            hold = []
    out += hold
    return tuple(sorted(out)) or None


def given_forms(token: str) -> list[str]:
    """The given names that a word may stand for."""
    return _GIVEN.get(token, [token])


def _same_given(a: str, b: str) -> float:
    """How well two words agree as given names: 1 the same or a short form, .9 a slip, .6 an initial, 0 not."""
    if set(given_forms(a)) & set(given_forms(b)):
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.6 if any(x[0] == y[0] for x in given_forms(a) for y in given_forms(b)) else 0.0
    if min(len(a), len(b)) >= 4 and within_one(a, b):
        return 0.9
    return 0.0


def _same_surname(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = a.replace("-", ""), b.replace("-", "")
    if min(len(x), len(y)) >= 4 and within_one(x, y):
        return 0.95
    pa, pb = a.split("-"), b.split("-")
    if len(pa) != len(pb) and any(p == q or (min(len(p), len(q)) >= 4 and within_one(p, q)) for p in pa for q in pb):
        return 0.85
    if min(len(x), len(y)) >= 7 and edits(x, y, 2) <= 2:
        return 0.8
    return 0.0


def person_agreement(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """The best agreement of two persons' names over the choices of given name and surname; 0 if none."""
    best = 0.0
    for i, g in enumerate(a):
        for j, h in enumerate(b):
            s = _same_given(g, h)
            if not s:
                continue
            ra, rb = [w for k, w in enumerate(a) if k != i], [w for k, w in enumerate(b) if k != j]
            la, lb = [w for w in ra if len(w) > 1], [w for w in rb if len(w) > 1]
            if not la or not lb:
                continue
            t = max(_same_surname(x, y) for x in la for y in lb)
            ia, ib = [w for w in ra if len(w) == 1], [w for w in rb if len(w) == 1]
            if ia and ib and ia != ib:
                t *= 0.5
            best = max(best, s * t if max(len(g), len(h)) > 1 else 0.0)
    return best
