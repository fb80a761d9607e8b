"""Variant spellings of names typed by people (problem 1).

Method: trie join.  Every identity is read into keys (cleaned name in sorted token order, personal
address, account handle, organisation) and parts.  The distinct names are sharded into tries; each
name walks its shard's trie with a Levenshtein automaton (swaps included), which yields
its neighbours; token-order permutations fall together because shards hold the tokens of a name
under either order.  A neighbour becomes a link only with evidence: a shared address, a spelling the
address itself gives, or a given name that hardly occurs beside one that often does.  Initials,
nicknames and logins are completed if exactly one person fits.  Links are closed to components.

Bound: two edits where both tokens have ten letters or more, else one.

Sharding: edits change one token, so the others are exact: a shard is the exact tokens together with a
piece of the changed one that the edits leave whole.  Of one edit, which touches two neighbouring
letters at most, first or last letters stay (one, two or three of them by length; lengths of a pair
share a class).  Of two edits in ten letters or more, the first three, the last three or the middle two
stay, the middle at most three places away from where the other name has its own.

A shard of more than ``shard_size`` names is cut into blocks: each pair of a trie's block and a walkers'
block is a task of its own, which holds the trie only and streams the walkers.

Which tokens are given names, and which given names are short for which, is learned from the table
itself: a given name stands first much oftener than last, and a short form shares addresses and family
names with its full form.  A list of common short forms (fixed values) is added to the latter.

Components by repeated minimum over keys, hash aggregations only; lineage is cut in each round and
nothing is collected but a changed-rows count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.name_text import NICKNAMES, Identity, name_tokens, nobody
from plinth.operators.hot_join import hot_join
from plinth.operators.lineage import cut, written
from plinth.operators.spreading import spread

# ---------------------------------------------------------------- trie and automaton


class Trie:
    """Words by letters; each end holds the word."""

    def __init__(self, words) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = w

    def neighbours(self, word: str, most: int = 1) -> dict[str, int]:
        """Words within ``most`` edits and their distance, swaps of neighbouring letters being one edit.

        The automaton's state is a row of edit distances (with the row before, for swaps); a branch
        is left as soon as no entry of its state is within the bound.
        """
        found: dict[str, int] = {}
        first = tuple(range(len(word) + 1))
        stack = [(self.root, first, None, "")]
        while stack:
            node, row, before, letter = stack.pop()
            for ch, below in node.items():
                if ch == "":
                    if row[-1] <= most and below != word:
                        found[below] = row[-1]
                    continue
                new = [row[0] + 1]
                for k in range(1, len(word) + 1):
                    d = min(row[k] + 1, new[k - 1] + 1, row[k - 1] + (word[k - 1] != ch))
                    if before is not None and k > 1 and word[k - 1] == letter and word[k - 2] == ch:
                        d = min(d, before[k - 2] + 1)
                    new.append(d)
                if min(new) <= most or (min(row) < most and before is not None):
                    stack.append((below, tuple(new), row, ch))
        return found


#: Tokens of so many letters may differ by two edits.
LONG = 10


def bound(a: str, b: str) -> int:
    return 2 if min(len(a), len(b)) >= LONG else 1


def shards(tokens: tuple[str, ...]) -> list[tuple[str, str, bool]]:
    """(shard, token to vary, whether it enters the trie) of a name of two tokens or more, for each token; the others are exact."""
    out = []
    for k, vary in enumerate(tokens):
        exact = " ".join(tokens[:k] + tokens[k + 1 :])
        n = len(vary)
        for piece, least, most in ((1, 0, 5), (2, 5, 8), (3, 8, n)):
            if least <= n <= most:
                out += [(f"{exact}|{vary[:piece]}-{piece}", vary, True), (f"{exact}|-{vary[-piece:]}{piece}", vary, True)]
        if n >= LONG:
            centre = (n - 2) // 2
            out.append((f"{exact}|-{vary[centre : centre + 2]}-", vary, True))
            held = {vary[centre + d : centre + d + 2] for d in range(-3, 4)} - {vary[centre : centre + 2]}
            out += [(f"{exact}|-{x}-", vary, False) for x in sorted(held)]
    return out


def _emit_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(s, v, n, own) for n in b["name"] for s, v, own in shards(tuple(n.split(" ")))]
        yield pd.DataFrame(rows, columns=["shard", "vary", "name", "own"])


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one part are contiguous, the trie's names first: these are held, all others walk as they come."""
    current, names, trie = None, {}, None
    for b in batches:
        found = []
        for part, walks, v, n in zip(b["part"], b["walks"], b["vary"], b["name"], strict=True):
            if part != current:
                current, names, trie = part, {}, None
            if not walks:
                names[v] = n
                continue
            if not names:
                continue
            if trie is None:
                trie = Trie(names)
            for other, d in trie.neighbours(v, 2 if len(v) >= LONG else 1).items():
                if d <= bound(v, other):
                    found += [(n, names[other]), (names[other], n)]
        yield pd.DataFrame(found, columns=["a", "b"], dtype=object)


def similar_names(names: DataFrame, shard_size: int = 20_000) -> DataFrame:
    """Pairs ``a, b`` (both directions) of names a few edits apart in one of their tokens; ``names`` has ``name``, distinct, tokens sorted."""
    spread_out = names.mapInPandas(_emit_shards, "shard string, vary string, name string, own boolean")
    sizes = spread_out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any")).where((F.col("n") > 1) & F.col("any")).withColumn("blocks", F.ceil(F.col("n") / shard_size).cast("int"))
    sizes = written(sizes, "shards")
    both = hot_join(spread_out, sizes.select("shard", "blocks"), ["shard"], counts=sizes.select("shard", "n"))
    home = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
    # A name is in its own block's trie for every block of walkers, and walks every block's trie in its own block of walkers.
    each = lambda walks: F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.alias("k"), F.lit(walks).alias("walks")))
    turn = F.explode(F.concat(each(False), each(True))).alias("t")
    cut_up = both.withColumn("home", home).select("shard", "vary", "name", "own", "home", turn).where(F.col("own") | F.col("t.walks"))
    block = F.when(F.col("t.walks"), F.concat_ws("#", "shard", F.col("t.k").cast("string"), F.col("home").cast("string"))).otherwise(F.concat_ws("#", "shard", F.col("home").cast("string"), F.col("t.k").cast("string")))
    walked = cut_up.select(block.alias("part"), F.col("t.walks").alias("walks"), "vary", "name")
    return walked.repartition("part").sortWithinPartitions("part", "walks").mapInPandas(_walk, "a string, b string").where(F.col("a") != F.col("b")).distinct()


# ---------------------------------------------------------------- identities

_READ = "id bigint, keys array<string>, given string, family string, mail_given string, mail_family string, letter string, initial_family string, loose array<string>, email string, fam string"


def _read(given: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, name, address in zip(b["id"], b["name"], b["address"], strict=True):
                x = Identity(name if isinstance(name, str) else None, address if isinstance(address, str) else None, given)
                rows.append((i, sorted(x.keys), *(x.full or (None, None)), *(x.from_mail or (None, None)), *(x.initial or (None, None)), [f"{a} {f}" for a, f in x.loose], x.email, x.fam))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _READ.split(", ")])

    return run


def _positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First and last token of names of two tokens or more."""
    for b in batches:
        rows = []
        for name in b["name"]:
            ws = [w for w in name_tokens(name) if len(w) > 1] if isinstance(name, str) and not nobody(name) else []
            if len(ws) > 1:
                rows += [(ws[0], 1, 0), (ws[-1], 0, 1)]
        yield pd.DataFrame(rows, columns=["token", "first", "last"])


def given_names(narrow: DataFrame, least: int = 5, shares: int = 20_000, ratio: int = 4) -> list[str]:
    """Tokens that stand first ``ratio`` times oftener than last, and in more than ``1 / shares`` of the names: no more than ``shares`` tokens, whatever the table."""
    counts = narrow.select("name").mapInPandas(_positions, "token string, first int, last int").groupBy("token").agg(F.sum("first").alias("first"), F.sum("last").alias("last"))
    counts = written(counts, "tokens")
    total = counts.agg(F.sum("first")).first()[0] or 0
    often = counts.where((F.col("first") >= max(least, total / shares)) & (F.col("first") >= ratio * F.col("last")))
    return [r["token"] for r in often.select("token").collect()]


def learned_forms(named: DataFrame, families: int = 3, block: int = 1_000) -> DataFrame:
    """``given, full``: given names that stand for the same person under ``families`` family names or more, the shorter one first.

    They share an address and a family name; every pair of given names of an address and a family name counts,
    however many there are.  A group of more than ``block`` of them is cut, and each pair of blocks has a join key of its own.
    """
    uses = named.where(F.col("email").isNotNull()).select("email", "family", "given").distinct()
    # Of equal length or one letter apart is a misspelling, not a short form.
    groups = uses.groupBy("email", "family").agg(F.min(F.length("given")).alias("least"), F.max(F.length("given")).alias("most"))
    uses = uses.join(groups.where(F.col("least") + 2 <= F.col("most")).select("email", "family"), ["email", "family"])
    # A given name that is there under fewer families can be in no pair that has enough of them.
    often = uses.groupBy("given").agg(F.count_distinct("family").alias("n")).where(F.col("n") >= families).select("given")
    uses = written(uses.join(often, "given"), "uses")
    sizes = uses.groupBy("email", "family").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = uses.join(sizes, ["email", "family"]).withColumn("home", F.pmod(F.xxhash64("given"), F.col("blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    shorter = placed.select("email", "family", "given", F.col("home").alias("i"), each.alias("j"))
    longer = placed.select("email", "family", F.col("given").alias("full"), each.alias("i"), F.col("home").alias("j"))
    both = shorter.join(longer, ["email", "family", "i", "j"]).where(F.length("given") + 2 <= F.length("full"))
    return both.groupBy("given", "full").agg(F.count_distinct("family").alias("n")).where(F.col("n") >= families).select("given", "full")


def _key(given: str, family: str):
    return F.concat(F.lit("W:"), F.array_join(F.array_sort(F.array(F.col(given), F.col(family))), " "))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, component``: the smallest id reachable; ``edges`` is ``id, key`` and rows with a common key are linked.

    Each round takes minima over keys and over ids, then follows labels of labels (pointer jumping),
    so long chains close in logarithmically many rounds; ``rounds`` is beyond any table's need and passing
    it is an error, never a partial result.
    """
    edges = written(edges.distinct(), "edges")
    labels = cut(edges.select("id", F.col("id").alias("component")).distinct())
    for _ in range(rounds):
        by_key = edges.join(labels, "id").groupBy("key").agg(F.min("component").alias("m"))
        lower = edges.join(by_key, "key").groupBy("id").agg(F.min("m").alias("component"))
        jump = lower.alias("l").join(lower.select(F.col("id").alias("r"), F.col("component").alias("c2")), F.col("l.component") == F.col("r")).select("l.id", F.col("c2").alias("component"))
        new = cut(jump)
        changed = new.join(labels.withColumnRenamed("component", "old"), "id").where(F.col("component") != F.col("old")).limit(1).count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def similar_organisations(read: DataFrame, least: int = 7) -> DataFrame:
    """``id, key``: identities of an organisation or team whose name is a misspelling, with the key of the right one.

    A name that neither holds nor is known by the mail label of an organisation is linked to its
    neighbour in the tries if all its neighbours are one organisation.  The misspelt token has
    ``least`` letters or more and no digits.
    """
    keys = read.where(F.col("given").isNull() & F.col("mail_given").isNull() & F.col("letter").isNull()).select("id", F.explode("keys").alias("key"))
    org = keys.where(F.col("key").startswith("W:")).select("id", F.expr("substring(key, 3)").alias("name")).where(F.col("name").contains(" "))
    own = keys.where(F.col("key").startswith("O:")).select("id", F.expr("substring(key, 3)").alias("label"))
    names = org.select("name").distinct()
    spelt = names.select("name", F.explode(F.split("name", " ")).alias("label")).join(own.select("label").distinct(), "label").select("name", "label")
    labels = spelt.unionByName(org.join(own, "id").select("name", "label")).groupBy("name").agg(F.min("label").alias("label"))
    pairs = similar_names(names)
    # The token that differs, on either side.
    differ = lambda x, y: F.element_at(F.array_except(F.split(x, " "), F.split(y, " ")), 1)
    letters = f"^[a-z]{{{least},}}$"
    pairs = pairs.where(differ("a", "b").rlike(letters) & differ("b", "a").rlike(letters))
    unknown = pairs.join(labels.select(F.col("name").alias("a")), "a", "left_anti")
    near = unknown.join(labels.select(F.col("name").alias("b"), "label"), "b", "left")
    one = near.groupBy("a").agg(F.count_distinct(F.coalesce("label", "b")).alias("n"), F.min("b").alias("b")).where(F.col("n") == 1)
    return org.join(one.select(F.col("a").alias("name"), "b"), "name").select("id", F.concat(F.lit("W:"), "b").alias("key"))


def persons(identities: DataFrame, ident: str = "identity_id", name: str = "author_name", address: str = "author_email", common: int = 8) -> DataFrame:
    """``id, component``: identities that belong to the same person or organisation.

    * Null names and addresses are read as missing; an identity that stands for nobody (placeholders,
      missing or role addresses without a name) is not in the result at all, or alone.
    * Role addresses link nothing; an address used with different family names links only equal ones.
    * Repeated rows fall together; an empty table gives an empty result; other columns are not read.
    """
    narrow = spread(identities.select(F.col(ident).cast("bigint").alias("id"), F.col(name).alias("name"), F.col(address).alias("address")))
    known_given = given_names(narrow)
    read = written(narrow.mapInPandas(_read(frozenset(known_given)), _READ), "identities")
    direct = read.select("id", F.explode("keys").alias("key"))
    # Addresses: one family name, or one link group for each.
    mailed = read.where(F.col("email").isNotNull()).select("id", "email", "fam")
    families = mailed.where(F.col("fam").isNotNull()).select("email", "fam").distinct().groupBy("email").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.element_at(F.split("email", "@"), 1).contains(F.col("fam")), F.col("fam"))).alias("spelt"))
    by_mail = mailed.join(families, "email", "left")
    single = by_mail.where(F.coalesce("n", F.lit(0)) <= 1).select("id", F.concat(F.lit("E:"), "email").alias("key"))
    group = F.coalesce("fam", "spelt")
    several = by_mail.where((F.col("n") > 1) & group.isNotNull()).select("id", F.concat(F.lit("E:"), "email", F.lit("|"), group).alias("key"))
    # Names, and how well each is supported.
    named = read.where(F.col("given").isNotNull()).select("id", "given", "family", "email", _key("given", "family").alias("key"))
    from_mail = read.where(F.col("mail_given").isNotNull()).select("id", F.col("mail_given").alias("given"), F.col("mail_family").alias("family"), "email", _key("mail_given", "mail_family").alias("key"))
    whole = named.unionByName(from_mail)
    # Of the two orders of a name the one most identities have; the least one of those.
    orders = whole.groupBy("key", "given", "family").agg(F.count_distinct("id").alias("n"))
    chosen = orders.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), "given", "family")).alias("best"))
    counted = whole.groupBy("key").agg(F.count_distinct("id").alias("rows"))
    names = written(chosen.join(counted, "key").select("key", F.col("best.given").alias("given"), F.col("best.family").alias("family"), "rows"), "names")
    givens = names.groupBy("given").agg(F.count(F.lit(1)).alias("uses"))
    # Trie join over distinct names.
    bare = names.select(F.expr("substring(key, 3)").alias("name")).where(F.col("name").contains(" "))
    pairs = written(similar_names(bare).select(F.concat(F.lit("W:"), "a").alias("a"), F.concat(F.lit("W:"), "b").alias("b")), "similar")
    # Evidence 1: the same address under both spellings.
    mails = whole.where(F.col("email").isNotNull()).select("key", "email").distinct()
    shared = pairs.join(mails.select(F.col("key").alias("a"), "email"), "a").join(mails.select(F.col("key").alias("b"), "email"), ["b", "email"]).select("a", "b").distinct()
    # Evidence 2: a given name that hardly occurs beside a common one, the family name being equal.
    # The list of learned given names has a bound of its own, see ``given_names``.
    listed = F.broadcast(names.sparkSession.createDataFrame([(x,) for x in known_given], "given string").withColumn("listed", F.lit(True)))
    g = names.join(givens, "given").join(listed, "given", "left").select("key", "given", "family", "uses", "rows", F.coalesce("listed", F.lit(False)).alias("listed"))
    g = written(g, "givens")
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("key", "given", "family", "uses", "rows", "listed")]
    typed = written(pairs.join(g.select(*side("x")), F.col("a") == F.col("x_key")).join(g.select(*side("y")), F.col("b") == F.col("y_key")), "typed")
    rare = (F.col("x_uses") * 4 <= F.col("y_uses")) & (F.col("y_uses") >= common)
    given_typo = typed.where((F.col("x_family") == F.col("y_family")) & (rare | (F.col("y_listed") & ~F.col("x_listed") & (F.col("x_uses") <= 2)))).select("a", "b")
    # Evidence 3: the account spells the family name as the neighbour does.
    spelt = read.where(F.col("given").isNotNull()).select(_key("given", "family").alias("a"), F.col("given"), F.explode("loose").alias("loose"))
    spelt = spelt.select("a", F.concat(F.lit("W:"), F.array_join(F.array_sort(F.array("given", F.element_at(F.split("loose", " "), 2))), " ")).alias("b"))
    spelt = spelt.join(names.select(F.col("key").alias("b")), "b").select("a", "b")
    # Evidence 4: a name seen once, without an address that says more, and one neighbour that is well known.
    plain = read.where(F.col("given").isNotNull() & F.col("email").isNull()).select(_key("given", "family").alias("a")).distinct()
    once = typed.where((F.col("x_rows") == 1) & (F.col("y_rows") >= 2) & (F.substring("x_family", 1, 1) == F.substring("y_family", 1, 1)) & (F.col("x_given") == F.col("y_given")))
    lonely = once.groupBy("a").agg(F.count_distinct("b").alias("n"), F.min("b").alias("b")).where(F.col("n") == 1).join(plain, "a").select("a", "b")
    typos = written(shared.unionByName(given_typo).unionByName(spelt).unionByName(lonely).distinct(), "typos")
    # Names one typo apart become one name for what follows; the common spelling is its head.
    head = typos.join(names.select(F.col("key").alias("b"), "rows"), "b").groupBy("a").agg(F.max_by("b", F.struct("rows", "b")).alias("head"))
    weight = names.join(head.withColumnRenamed("a", "key"), "key", "left").join(names.select(F.col("key").alias("head"), F.col("rows").alias("head_rows")), "head", "left")
    proper = written(weight.where(F.col("head").isNull() | (F.col("rows") > F.col("head_rows")) | ((F.col("rows") == F.col("head_rows")) & (F.col("key") < F.col("head")))).select("key", "given", "family", "rows"), "proper")
    # Nicknames: another form of the given name with the same family name.
    forms = proper.sparkSession.createDataFrame([(s, f) for f, shorts in NICKNAMES.items() for s in shorts.split()], "given string, full string").unionByName(learned_forms(whole)).distinct()
    nick = proper.select("given", "family", F.col("key").alias("a")).join(forms, "given").select("full", "family", "a")
    nick = nick.join(proper.select(F.col("given").alias("full"), "family", F.col("key").alias("b")), ["full", "family"])
    nick = nick.groupBy("a").agg(F.count_distinct("b").alias("n"), F.min("b").alias("b")).where(F.col("n") == 1).select("a", "b")
    # Short forms that are the beginning of exactly one given name of that family.
    # Each given name offers its beginnings: an equi-join, not a comparison of all names of a family.
    short = proper.select(F.col("given").alias("s"), "family", F.col("key").alias("a")).where(F.length("s") >= 3)
    begins = proper.where(F.length("given") >= 5).select(F.explode(F.transform(F.sequence(F.lit(3), F.length("given") - 2), lambda n: F.substring("given", F.lit(1), n))).alias("s"), "family", F.col("key").alias("b"))
    begun = short.join(begins, ["family", "s"]).where(F.col("a") != F.col("b")).select("a", "b")
    begun = begun.groupBy("a").agg(F.count_distinct("b").alias("n"), F.min("b").alias("b")).where(F.col("n") == 1).select("a", "b")
    short_forms = written(nick.unionByName(begun).distinct(), "short-forms")
    # Initials and logins, if exactly one given name of the family begins so (nicknames stand for their full form).
    heads = proper.join(short_forms.select(F.col("a").alias("key")).distinct(), "key", "left_anti")
    candidates = heads.select(F.substring("given", 1, 1).alias("letter"), "family", "key").distinct()
    one = candidates.groupBy("letter", "family").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).where(F.col("n") == 1).select("letter", "family", "key")
    one = written(one, "initials")
    initial = read.where(F.col("letter").isNotNull()).select("id", "letter", F.col("initial_family").alias("family")).join(one, ["letter", "family"]).select("id", "key")
    logins = read.where(F.col("given").isNull() & F.col("letter").isNull()).select("id", F.explode("loose").alias("loose"))
    logins = logins.select("id", F.element_at(F.split("loose", " "), 1).alias("letter"), F.element_at(F.split("loose", " "), 2).alias("family")).join(one, ["letter", "family"])
    logins = logins.groupBy("id").agg(F.count_distinct("key").alias("n"), F.min("key").alias("key")).where(F.col("n") == 1).select("id", "key")
    # Links between names are links of every identity of the first with the second's key.
    links = typos.unionByName(short_forms).distinct()
    through = whole.select("id", F.col("key").alias("a")).join(links, "a").select("id", F.col("b").alias("key"))
    edges = direct.unionByName(similar_organisations(read)).unionByName(single).unionByName(several).unionByName(initial).unionByName(logins).unionByName(through)
    return components(edges)


def pairs_of(members: DataFrame) -> DataFrame:
    """All pairs within a component: ``identity_id_a < identity_id_b``; a component is one person's spellings."""
    a = members.select(F.col("id").alias("identity_id_a"), "component")
    b = members.select(F.col("id").alias("identity_id_b"), "component")
    return a.join(b, "component").where(F.col("identity_id_a") < F.col("identity_id_b")).select("identity_id_a", "identity_id_b")


