import random

from plinth.llm import people
from plinth.llm.name_text import Identity, close, email, name_tokens


def osa(a, b):
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def made(rng, n):
    return sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(n)})


def test_trie_against_brute_force():
    rng = random.Random(1)
    words = made(rng, 300)
    trie = people.Trie(words)
    for w in words[:80]:
        assert trie.neighbours(w) == {x: 1 for x in words if osa(w, x) == 1}
        assert trie.neighbours(w, 2) == {x: osa(w, x) for x in words if x != w and osa(w, x) <= 2}
    for a in words[:60]:
        for b in words[:60]:
            assert close(a, b) == (osa(a, b) <= 1)


def test_similar_names_against_brute_force(spark):
    rng = random.Random(2)
    given = ["anna", "berta", "carlotta", "annna", "bertha"]
    fam = ["".join(rng.choice(["bar", "gol", "ven", "tar", "inwick", "qvist"]) for _ in range(rng.randint(2, 3))) for _ in range(25)]
    fam += [f[:k] + f[k + 1 :] for f in fam[:12] for k in (0, 3, len(f) - 1)] + [f[:2] + f[3] + f[2] + f[4:] for f in fam[:12] if f[2] != f[3]]
    long = ["".join(rng.choice(["bar", "gol", "ven", "tar"]) for _ in range(4)) for _ in range(12)]
    for w in long:
        for _ in range(14):  # one to three random edits
            v = w
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(v) - 1)
                v = rng.choice([v[:k] + v[k + 1 :], v[:k] + rng.choice("xyz") + v[k:], v[:k] + rng.choice("xyz") + v[k + 1 :], v[:k] + v[k + 1] + v[k] + v[k + 2 :]])
            fam.append(v)
    fam += long
    names = sorted({" ".join(sorted((rng.choice(given), f))) for f in fam for _ in range(2)})
    want = set()
    for a in names:
        for b in names:
            (p, q), (r, s) = a.split(), b.split()
            if a != b and any(x == y and abs(len(v) - len(w)) < 3 and 0 < osa(v, w) <= people.bound(v, w) for x, v, y, w in ((p, q, r, s), (p, q, s, r), (q, p, r, s), (q, p, s, r))):
                want.add((a, b))
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for size in (20_000, 3):
        assert {tuple(r) for r in people.similar_names(df, size).collect()} == want


def test_reading():
    assert name_tokens("Garaitonko, Yevgeniya") == ["yevgeniya", "garaitonko"]
    assert name_tokens("SÃ¸ren Selgamolf (contractor)") == ["soren", "selgamolf"]
    assert name_tokens("MagdalenaDenbavogh") == ["magdalena", "denbavogh"]
    assert email("Katarzyna Fangelinthal <fangka902+ci@Mesh.Example>") == ("fangka902", "mesh.example")
    assert email("a.b [at] mailbag dot example") == ("a.b", "mailbag.example")
    assert email("(none)") is None and email(None) is None
    assert Identity("Trish Renbarumper", "patricia.renbarumper@x.example").from_mail == ("patricia", "renbarumper")


def test_persons(spark):
    rows = [
        (1, "Jonathan Korniparth", "jonathan.korniparth@mail.example"), (2, "korniparth jonathan", "jk@other.example"), (3, "Jonathan Kornipatrh", "jonathan.korniparth@mail.example"), (4, "J. Korniparth", "noreply@forge.example"),
        (5, "Jon Korniparth", None), (6, "Maria Korniparth", "maria.korniparth@mail.example"), (7, "Robert Palgovant", "root@build.example"), (8, "Robert Palgovantova", "root@build.example"),
        (9, "Your Name", "you@placeholder.invalid"), (10, None, None), (11, "", "(none)"), (12, "Patchwheel Bot", "bot@patchwheel.example"), (13, "PB Patchwheel", "ci@patchwheel.example"), (14, "PATCHWHEEL BOT", None), (15, "unknown", None), (16, "unknown", None),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "identity_id bigint, author_name string, author_email string, id int")
    got = {}
    for r in people.persons(df).collect():
        got.setdefault(r.component, set()).add(r.id)
    assert sorted(map(sorted, (v for v in got.values() if len(v) > 1))) == [[1, 2, 3, 4, 5], [12, 13, 14]]
    pairs = people.pairs_of(people.persons(df))
    assert {tuple(r) for r in pairs.collect()} == {(a, b) for v in got.values() for a in v for b in v if a < b}
    assert people.persons(df.limit(0)).count() == 0


def test_given_names_and_short_forms_are_learned(spark):
    families = ["corvand", "delmuth", "ostrava", "peltram", "quenby", "rastow"]
    rows = [("Zorbelina", f) for f in families] + [("Zib", f) for f in families]
    identities = [(k, f"{g} {f}", f"m{k % 6}.{f}@mail.example", 0) for k, (g, f) in enumerate(rows)]
    identities += [(50, "Zib Lonewood", None, 0), (51, "Zorbelina Lonewood", None, 0), (52, "Lonewood Zorbelina", None, 0), (60, "Kim Lee", None, 0), (61, "Lee Kim", None, 0)]
    df = spark.createDataFrame(identities, "identity_id bigint, author_name string, author_email string, n int")
    narrow = df.selectExpr("identity_id AS id", "author_name AS name", "author_email AS address")
    assert set(people.given_names(narrow)) == {"zorbelina", "zib"}
    got = {}
    for r in people.persons(df).collect():
        got.setdefault(r.component, set()).add(r.id)
    groups = sorted(sorted(v) for v in got.values())
    assert [50, 51, 52] in groups and [60, 61] in groups and all([k, k + 6] in groups for k in range(6))


def test_short_forms_of_addresses_with_many_given_names(spark):
    """Every pair of given names of an address and a family name counts, however many there are."""
    rng = random.Random(3)
    given = made(rng, 60)
    rows = [("zib", f, f"all@{f}.example") for f in ("corvand", "delmuth", "ostrava")] + [("zorbelina", f, f"all@{f}.example") for f in ("corvand", "delmuth", "ostrava")]
    rows += [(f"{f[:3]}{'x' * k}", f, f"all@{f}.example") for f in ("corvand", "delmuth", "ostrava") for k in range(9)]  # nine others, under one family each
    rows += [(g, f, f"m{k}@{f}.example") for f in ("peltram", "quenby", "rastow", "sunder") for k, n in enumerate((2, 9, 40)) for g in rng.sample(given, n)]
    rows += [("zib", "quenby", None), ("zorbelo", "quenby", None)]
    groups = {}
    for g, f, m in rows:
        if m:
            groups.setdefault((f, m), set()).add(g)
    under = {}
    for (f, _), gs in groups.items():
        for a in gs:
            for b in gs:
                if len(a) + 2 <= len(b):
                    under.setdefault((a, b), set()).add(f)
    want = {p for p, fs in under.items() if len(fs) >= 3}
    df = spark.createDataFrame(rows, "given string, family string, email string")
    assert ("zib", "zorbelina") in want and len(want) > 50
    assert {tuple(r) for r in people.learned_forms(df).collect()} == want
    for block in (1, 7):
        assert {tuple(r) for r in people.learned_forms(df, block=block).collect()} == want


def test_a_family_with_very_many_names(spark):
    """Work grows with the names, not with their pairs: short forms join on beginnings, shards are cut on both sides."""
    import time

    df = spark.range(6_000).selectExpr("id AS identity_id", "concat(translate(cast(id AS string), '0123456789', 'abcdefghij'), 'o ', 'hotfamily') AS author_name", "CAST(NULL AS STRING) AS author_email")
    began = time.time()
    assert people.persons(df).count() > 0 and time.time() - began < 120


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, f"k{j}") for k in range(200) for j in (k, k + 1)] + [(500, "z"), (501, "z")], "id bigint, key string")
    got = {r.id: r.component for r in people.components(edges).collect()}
    assert set(got.values()) == {0, 500} and len(got) == 202


def test_misspelt_organisations(spark):
    rows = [
        (1, "Patchwhel Bot", None), (2, "Patchwheel Bot", None),  # nothing but the spelling
        (3, "Dorbalumper Platform Team", "ci@dorbalumper.example"), (4, "Platform Team, Dorbalumpr", "noreply@forge.example"),
        (5, "Holbatilsen Docs Group", "docs@holbatilsen.example"), (6, "Holbatulsen Docs Group", "docs@holbatulsen.example"),  # two organisations
        (7, "Holbatilsen Storage Team", None), (8, "Holbatulsen Storage Team", None), (9, "Holbatalsen Docs Group", None),  # between the two
        (10, "builder1 automation bot", None), (11, "builder2 automation bot", None),
    ]
    df = spark.createDataFrame(rows, "identity_id bigint, author_name string, author_email string")
    assert {tuple(r) for r in people.pairs_of(people.persons(df)).collect()} == {(1, 2), (3, 4)}
    assert {tuple(r) for r in people.similar_names(spark.createDataFrame([("a bb platforms",), ("a bb platform",), ("a cc platform",)], "name string")).collect()} == {("a bb platforms", "a bb platform"), ("a bb platform", "a bb platforms")}
