import hashlib
import random
from collections import Counter
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from logtide.llm import lines

from .conftest import make
from .test_simhash import roots


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("ab", max_size=12), st.text("abc", max_size=12), st.integers(0, 4))
def test_banded_distance(a, b, most):
    want = edit(a, b)
    assert lines.distance_within(a, b, most) == (want if want <= most else None)


def expected(rows):
    copies, least = Counter(), {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            copies[line] += 1
            least.setdefault(line, set()).add(i)
    own = list(copies)
    links = [(a, b) for a, b in combinations(own, 2) if abs(len(a) - len(b)) <= 2 and edit(a, b) <= 2]
    names = {x: hashlib.md5(x.encode()).hexdigest() for x in own}
    n = Counter(x for pair in links for x in pair)
    found = roots(names.values(), [(names[a], names[b]) for a, b in links])
    return sorted((names[x], str(min((i for i in least[x] if i is not None), default=None)), copies[x], n[x], found[names[x]]) for x in own)


def varied(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.choice([10, 23, 24, 25, 30, 61]))) for _ in range(12)]
    rows = []
    for i in range(50):
        own = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(line))
                line[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
            own.append("".join(line))
        rows.append((i, "\n".join(own)))
    return [*rows, (60, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (None, rows[0][1]), (61, None), (61, "")]


def test_against_brute_force(spark, monkeypatch):
    rows = varied(2)
    got = lambda: sorted((r[0], str(r[1]), *r[2:]) for r in lines.join_lines(make(spark, rows)).collect())
    assert got() == expected(rows)
    monkeypatch.setattr(lines, "BLOCK", 4)
    assert got() == expected(rows)


def test_odd_rows(odd, odd_rows, empty):
    rows = lines.join_lines(odd).collect()
    assert sum(r["n_copies"] for r in rows) == sum((t or "").count("\n") + 1 for _, t in odd_rows)
    assert lines.join_lines(empty).collect() == []


def test_short_lines(spark):
    rng = random.Random(7)
    own = ["".join(rng.choice("abé ") for _ in range(n)) for n in range(27) for _ in range(3)]
    own += [line[:at] + new + line[at + gone :] for line in own for new, gone in (("x", 0), ("xy", 1), ("", 2)) for at in (rng.randint(0, len(line)),)]
    own = sorted({*own, "Are, is anwh reenen.", "Are. Is anwh reenen.", "\U0001f600", "a" * 23, "a" * 24})
    links = [(a, b) for a, b in combinations(own, 2) if edit(a, b) <= 2]
    assert any(max(len(a), len(b)) == 24 > min(len(a), len(b)) for a, b in links)
    n = Counter(x for pair in links for x in pair)
    names = {x: hashlib.md5(x.encode()).hexdigest() for x in own}
    found = roots(names.values(), [(names[a], names[b]) for a, b in links])
    got = {r["line_id"]: (r["n_links"], r["class_id"]) for r in lines.join_lines(make(spark, list(enumerate(own)))).collect()}
    assert got == {names[x]: (n[x], found[names[x]]) for x in own}


def test_members_and_texts_without_copies(spark):
    rows = [(1, "a line that many have\nown line of the first one"), (2, "a line that many have.\nsomething else entirely here"), (2, "a line that many have.\nsomething else entirely here"), (3, "a line that many have"), (None, "a line thut many have\nlast words of the nameless")]
    classes = {r["line_id"]: r["class_id"] for r in lines.join_lines(make(spark, rows)).collect()}
    name = lambda line: hashlib.md5(line.encode()).hexdigest()
    want = sorted((str(i), place, name(line), classes[name(line)]) for i, t in rows for place, line in enumerate(t.split("\n")))
    assert sorted((str(r["doc_id"]), r["place"], r["line_id"], r["class_id"]) for r in lines.members(make(spark, rows)).collect()) == want
    got = {r["doc_id"]: r["text"] for r in lines.without_copies(make(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "something else entirely here", None: "last words of the nameless"}
