"""How a typed name comes from a true one: the channel that p4 and p5 share.

`org_cost` and `person_cost` give the price (a negative log likelihood up to a
constant) of writing one name for another, or None where no single way of
writing explains it: typing slips, letter case, spacing, reordering, dropped
small words, shortened words, initials, nicknames, titles and added notes.
"""

from __future__ import annotations

import re
import unicodedata

# Small words that names drop, titles, and short forms of given names.
SMALL = frozenset("the of and for in on a an de la du".split())
TITLES = frozenset("mr mrs ms miss dr prof professor sir madam".split())
NICKNAMES = {
    "alexander": "alex sandy al xander sasha", "andrew": "andy drew", "anthony": "tony ant", "anouk": "nouk", "benedict": "ben benny", "benjamin": "ben benny",
    "catherine": "kate cathy katie kitty cat", "charles": "charlie chuck", "christine": "chris tina chrissy", "christopher": "chris topher kit", "daniel": "dan danny",
    "david": "dave davy", "deborah": "deb debbie debby", "dorothea": "dot dottie thea dora", "dorothy": "dot dottie", "eamon": "ed eddie", "edward": "ed ted eddie ned",
    "elizabeth": "liz beth betty eliza lizzie libby lisa", "frederick": "fred freddie freddy", "gregory": "greg", "harriet": "hattie harry", "henry": "harry hank", "ingrid": "inge",
    "jacqueline": "jackie jacqui", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "joaquin": "quino", "john": "jack johnny", "joseph": "joe joey", "katherine": "kate kathy katie kat kitty kath",
    "lawrence": "larry laurie lars", "leilani": "lani lei", "mei-lin": "mei", "margaret": "peggy maggie meg marge madge", "matthew": "matt", "michael": "mike mick mickey", "nathaniel": "nat nate nathan", "nicholas": "nick",
    "noemie": "noe mimi", "oluchi": "olu", "patricia": "pat patty trish tricia", "patrick": "pat paddy", "priya": "pri", "rashid": "rash", "rebecca": "becky", "richard": "rick dick rich richie ricky",
    "robert": "bob rob bobby robbie bert", "samuel": "sam", "soraya": "raya", "stephen": "steve", "susan": "sue susie", "susannah": "sue susie susan anna", "theodore": "ted theo teddy", "thomas": "tom tommy",
    "tomasz": "tom tomek", "victoria": "vicky vic tori vickie", "wilhelmina": "mina willa billie wilma minnie", "william": "will bill billy willy liam", "yusuf": "joe yus", "zsofia": "zsofi sofia",
}
_SHORT = {(n, full) for full, ns in NICKNAMES.items() for n in ns.split()}


def fold(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", s).casefold() if not unicodedata.combining(c))


def edits(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (adjacent swaps count once), or most + 1 beyond `most`."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most or most == 0:
        return most + 1
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    # The unrestricted form: letters swapped across a dropped one count as two.
    far = len(a) + len(b)
    seen: dict[str, int] = {}
    d = [[far] * (len(b) + 2)] + [[far, i] + [0] * len(b) for i in range(len(a) + 1)]
    d[1][1:] = range(len(b) + 1)
    for i, x in enumerate(a, 1):
        match = 0
        low = far
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), match
            if x == y:
                match = j
            v = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
            d[i + 1][j + 1] = v
            low = min(low, v)
        if low > most + 1:
            return most + 1
        seen[x] = i
    return min(d[-1][-1], most + 1)


def _slips(n: int) -> int:
    """How many slips a word of n letters may have."""
    return 0 if n < 4 else 1 if n < 8 else 2


# ------------------------------------------------------------- organisations


def org_words(s: str, notes: bool = False) -> list[str]:
    """Words of a body's name: notes in brackets dropped unless asked for, dotted initials joined, turned names set right."""
    s = fold(s).replace("&", " and ")
    bare = s if notes else re.sub(r"\([^)]*\)", " ", s)
    s = bare if re.search(r"\w", bare) else s
    s = re.sub(r"\b(\w)[./](?=\w\b)", r"\1", s)
    turned = re.match(r"^\s*([^,]+),\s*([^,]+)$", s)
    if not turned:
        turned = re.match(r"^\s*(\S+)\s+-\s+(.+)$", s)
    if turned:
        s = f"{turned[2]} {turned[1]}"
    return re.findall(r"[^\W_]+", s)


def big(words: list[str]) -> list[str]:
    """Words without the small ones, if any are left."""
    return [w for w in words if w not in SMALL] or words


def initials(words: list[str]) -> set[str]:
    """First letters, with and without small words."""
    return {"".join(w[0] for w in words), "".join(w[0] for w in big(words))}


def within(w: str, c: str) -> bool:
    """The letters of w occur in c in order."""
    rest = iter(c)
    return all(x in rest for x in w)


def word_cost(w: str, c: str) -> float | None:
    """Price of writing word w for c."""
    way = word_way(w, c)
    return way and way[0]


def word_way(w: str, c: str) -> tuple[float, bool] | None:
    """(price of writing word w for c, whether letters changed so that it may be another word)."""
    if w == c:
        return 0.0, False
    if len(w) >= 3 and c.startswith(w):
        return 0.5, False
    n = edits(w, c, _slips(min(len(w), len(c))))
    if n <= _slips(min(len(w), len(c))):
        return float(n), True
    if len(c) >= 4 and w.startswith(c) and len(w) - len(c) <= 2:
        return 0.6, True
    if len(w) >= 3 and len(c) >= 6 and w[0] == c[0] and w[-1] == c[-1] and within(w, c):
        return 0.7, False
    return None


def align(v: list[str], c: list[str]) -> tuple[float, int, int]:
    """(price of the matched words, words of v left over, words of c left over), cheapest word first."""
    return _align(v, c)[:3]


def _align(v: list[str], c: list[str]) -> tuple[float, int, int, bool]:
    pairs = sorted((*way, i, j) for i, w in enumerate(v) for j, x in enumerate(c) if (way := word_way(w, x)) is not None)
    vs, cs, total, changed = set(), set(), 0.0, False
    for k, other, i, j in pairs:
        if i not in vs and j not in cs:
            vs.add(i)
            cs.add(j)
            total += k
            changed |= other
    return total, len(v) - len(vs), len(c) - len(cs), changed


def org_cost(v: list[str], c: list[str], codes: frozenset[str] = frozenset()) -> float | None:
    """Price of writing the body c as v; codes are further initials of c."""
    way = org_way(v, c, codes)
    return way and way[0]


def org_way(v: list[str], c: list[str], codes: frozenset[str] = frozenset()) -> tuple[float, bool] | None:
    """(price, whether letters changed so that v may be another body), by the cheapest way of writing c as v."""
    if not v or not c:
        return None
    bv, bc = big(v), big(c)
    best: list[tuple[float, bool]] = []
    if bv == bc:
        return (0.0 if v == c else 0.2), False
    for a, b in (("".join(v), "".join(c)), ("".join(bv), "".join(bc))):
        most = min(3, max(0, min(len(a), len(b)) // 5)) if min(len(a), len(b)) >= 4 else 0
        n = edits(a, b, min(most, 2))
        if n <= min(most, 2):
            best.append((0.1 + n, n > 0))
    acr = initials(c) | codes
    if len(c) > 1:
        if len(v) == 1 and len(v[0]) >= 2 and v[0] in acr:
            best.append((1.0, False))
        elif len(v) > 1:
            for i in (0, -1):
                rest = v[1:] if i == 0 else v[:-1]
                if len(v[i]) >= 2 and v[i] in acr and v[i] not in c:
                    cost, extra, _, changed = _align(big(rest), bc)
                    if extra == 0:
                        best.append((1.2 + cost, changed))
    if len(bv) > 1 and len(bc) > 1:
        cost, extra, missing, changed = _align(bv, bc)
        if extra == 0 and missing == 0 and cost <= max(2.0, 0.5 * len(bc)):
            best.append((0.3 + cost, changed))
    return min(best) if best else None


# ------------------------------------------------------------------- persons


def person(s: str) -> list[tuple[str, str, float]]:
    """Readings of a person's name as (given, family, price); given may be '' or a letter."""
    s = re.sub(r"\([^)]*\)", " ", fold(s)).replace("'", "").replace("’", "")
    s = re.sub(r"^([^,]+),\s*[^,]*\s-\s.*$", r"\1", s)
    words = lambda x: [w for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", x) if w not in TITLES]
    head, comma, tail = s.partition(",")
    if comma and words(head) and words(tail):
        return [(words(tail)[0], words(head)[-1], 0.0)]
    w = words(s)
    if not w:
        return []
    if len(w) == 1:
        return [("", w[0], 0.0)]
    out = [(w[0], w[-1], 0.0)]
    if len(w) == 2 and min(map(len, w)) > 1:
        out.append((w[1], w[0], 0.3))
    return out


def _given(a: str, b: str) -> tuple[float, bool] | None:
    """(price, whether it may be another given name)."""
    if a == b:
        return 0.0, False
    if not a or not b:
        return 1.0, False
    if len(a) == 1 or len(b) == 1:
        return (0.7, False) if a[0] == b[0] else None
    if (a, b) in _SHORT or (b, a) in _SHORT:
        return 0.5, False
    if len(min(a, b, key=len)) >= 3 and (a.startswith(b) or b.startswith(a)):
        return 0.6, True
    n = edits(a.replace("-", ""), b.replace("-", ""), 2)
    if n == 2 and a[0] != b[0]:
        return None
    if n <= (1 if min(len(a), len(b)) < 6 else 2):
        return float(n), n > 0
    return None


def person_cost(v: list[tuple[str, str, float]], c: list[tuple[str, str, float]]) -> float | None:
    """Price of writing the person c as v, over the readings of both."""
    way = person_way(v, c)
    return way and way[0]


def person_way(v: list[tuple[str, str, float]], c: list[tuple[str, str, float]]) -> tuple[float, bool] | None:
    """(price, whether letters changed so that v may be another person), by the cheapest readings."""
    best: tuple[float, bool] | None = None
    for ga, fa, pa in v:
        for gb, fb, pb in c:
            g = _given(ga, gb)
            n = edits(fa, fb, 2)
            ways = []
            if n == 2 and fa[:1] != fb[:1]:
                n = 3  # another beginning and a second slip: another family
            if g is not None and n <= (0 if min(len(fa), len(fb)) < 4 else 1 if min(len(fa), len(fb)) < 7 else 2):
                ways.append((g[0] + n, g[1] or n > 0))
            # Initial and family name run together.
            for (g1, f1), (g2, f2) in (((ga, fa), (gb, fb)), ((gb, fb), (ga, fa))):
                if not g1 and g2 and len(f1) > 4:
                    n = edits(f1, g2[0] + f2, 1)
                    if n <= 1:
                        ways.append((0.7 + n, n > 0))
            for k, other in ways:
                if best is None or (k + pa + pb, other) < best:
                    best = k + pa + pb, other
    return best if best is not None and best[0] <= 3.0 else None
