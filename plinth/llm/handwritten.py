"""Generated, minified or vendored source files (problem 6).

Method: belief propagation over directory trees.  Each file (path in its repository) and each
directory is a node with one of five labels.  File evidence: name patterns, sizes of all its changes
(log-normal likelihoods of insertions and removals by kind of change) and what any stored content of
it shows (generator or origin notices, long lines, tables of numbers).  Parent and child are tied by
a compatibility table, so siblings inform each other through their directory: a tree named like
generated code whose files all look written by hand is not generated, and a file without evidence in
a vendored tree is vendored.  The tree has no cycles, so one pass up and one pass down give exact
marginals.

What sizes say is learned: changes whose name or content settles their label (and, for handwritten,
changes without any such sign) give median and spread of the logarithm of their counts, in aggregations
over all changes; weak round priors stand in where a label has few of them.

Scale: files send their message to their directory in one hash aggregation (map-side combined: a
directory with a third of all files is one row per map task).  What remains is the table of
directories.  Repositories of up to ``whole_tree`` directories are worked out whole, many in one task,
in arrays; larger ones level by level with joins on (repo, directory), lineage cut at each level, as many
levels as the deepest path has.  Both are exact and give the same.  Files take their directory's belief
by a join that spreads directories with very many files over many tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.operators.hot_join import hot_join
from plinth.operators.lineage import cut, written
from plinth.operators.spreading import spread

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
#: Compatibility of a directory's label (row) with a child's label (column).
COMPATIBLE = (
    (0.93, 0.012, 0.02, 0.012, 0.026),
    (0.06, 0.90, 0.015, 0.015, 0.01),
    (0.08, 0.04, 0.85, 0.02, 0.01),
    (0.02, 0.02, 0.02, 0.93, 0.01),
    (0.10, 0.05, 0.02, 0.03, 0.80),
)
#: Names of directories that hold copies of third parties, or output of tools.
VENDOR_DIRS = ("vendor", "vendors", "_vendor", "third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "bower_components", "jspm_packages", "external", "externals", "extern", "deps", "pods", "imported", "site-packages", "carthage")
GENERATED_DIRS = ("generated", "__generated__", "_generated", "gen", "generated-sources", "generated_sources", "autogenerated", "autogen", "__snapshots__", "snapshots")
MAYBE_DIRS = ("dist", "out", "mocks", "bundles", "static", "assets")
#: Patterns of whole file names.
LOCK_NAMES = r"(?i)(^|[.\-_])lock$|\.lock$|[\-.]lock\.(json|ya?ml|hcl)$|^(go\.sum|packages\.lock\.json|npm-shrinkwrap\.json|gemfile\.lock|pnpm-lock\.yaml)$"
GENERATED_NAMES = r"(?i)_pb2(_grpc)?\.pyi?$|\.pb\.(go|h|cc|c|cpp|rb|swift)$|\.g\.(dart|cs|ts)$|\.freezed\.dart$|\.designer\.(cs|vb)$|\.(auto)?gen(erated)?\.[a-z]+$|\.graphql\.ts$|\.snap$|\.(js|css|mjs|ts)\.map$|\.map$|^mock_.*\.go$|_generated\.[a-z]+$|^zz_generated\.|^(moc|ui|qrc)_.*\.autogen\.[a-z]+$"
MINIFIED_NAMES = r"(?i)[.\-_]min\.(js|mjs|css|html)$|[.\-]bundle\.(js|css)$"
#: File types in which minified code occurs.
WEB_TYPES = r"(?i)\.(js|mjs|cjs|ts|jsx|tsx|css|html|htm|rb|svg|vue)$"

#: Weak priors (as many observations as PRIOR_WEIGHT): mean and deviation of log(1 + count) of added files, of
#: insertions and of removals, by label: handwritten, generated, minified, vendored, blob.
PRIORS = (
    ((4.0, 1.2), (5.5, 1.2), (1.2, 0.4), (5.5, 1.2), (9.5, 1.2)),
    ((2.5, 1.0), (3.5, 1.0), (1.2, 0.4), (3.5, 1.0), (8.0, 1.0)),
    ((2.0, 1.0), (3.5, 1.0), (1.2, 0.4), (3.5, 1.0), (8.0, 1.0)),
)
PRIOR_WEIGHT = 40
#: A spread learned is never taken to be narrower than this.
NARROWEST = 0.3


def _anchor(path: Column) -> Column:
    """Label a path settles by itself: 1 generated, 2 minified, 3 vendored, 0 no sign of any; null for signs that settle nothing."""
    name = F.element_at(F.split(path, "/"), -1)
    inside = lambda names: path.rlike(r"(?i)(^|/)(" + "|".join(re.escape(n) for n in names) + ")/")
    return F.when(inside(VENDOR_DIRS), 3).when(name.rlike(MINIFIED_NAMES), 2).when(name.rlike(GENERATED_NAMES), 1).when(name.rlike(LOCK_NAMES) | inside(GENERATED_DIRS) | inside(MAYBE_DIRS), F.lit(None)).otherwise(0)


def learned_sizes(changes: DataFrame, flagged: DataFrame | None = None) -> tuple:
    """Like ``PRIORS``, after all changes were seen; ``flagged`` is ``label, mode, insertions, removals`` settled by content."""
    x = lambda c: F.log1p(F.greatest(F.col(c), F.lit(0)).cast("double"))
    named = changes.where(F.col("path").isNotNull()).select(_anchor(F.col("path")).alias("label"), "mode", "insertions", "removals").where(F.col("label").isNotNull())
    if flagged is not None:
        named = named.unionByName(flagged)
    kinds = ((F.col("mode") == "A", "insertions"), (F.col("mode") == "M", "insertions"), (F.col("mode").isin("M", "D"), "removals"))
    sums = []
    for k, (when, column) in enumerate(kinds):
        value = F.when(when, x(column))
        sums += [F.count(value).alias(f"n{k}"), F.percentile_approx(value, [0.16, 0.5, 0.84], 2000).alias(f"q{k}")]
    seen = {int(r["label"]): r for r in named.groupBy("label").agg(*sums).collect()}  # one row a label
    out = []
    for k in range(3):
        row = []
        for label in range(5):
            (mean, dev), r = PRIORS[k][label], seen.get(label)
            n = r[f"n{k}"] if r else 0
            if n:
                low, mid, high = r[f"q{k}"]
                mean = (mean * PRIOR_WEIGHT + mid * n) / (PRIOR_WEIGHT + n)
                dev = (dev * PRIOR_WEIGHT + max(NARROWEST, (high - low) / 2) * n) / (PRIOR_WEIGHT + n)
            row.append((mean, dev))
        out.append(tuple(row))
    return tuple(out)


def _fits(count: Column, table) -> list[Column]:
    """Log likelihoods of log(1 + count), with 2 % outliers of any size; 0 for a null count."""
    x = F.log1p(F.greatest(count, F.lit(0)).cast("double"))
    outlier = 0.02 / 12
    return [F.when(count.isNull(), 0.0).otherwise(F.log(F.lit(outlier) + F.exp(-0.5 * F.pow((x - mean) / dev, 2)) * (0.98 / (dev * math.sqrt(2 * math.pi))))) for mean, dev in table]


def change_evidence(changes: DataFrame, sizes: tuple = PRIORS) -> DataFrame:
    """``repo, path, l0..l4``: summed size likelihoods of all changes of a file (any number of rows)."""
    mode, ins, rem = F.col("mode"), F.col("insertions"), F.col("removals")
    added, changed, removed = _fits(ins, sizes[0]), _fits(ins, sizes[1]), _fits(rem, sizes[2])
    columns = []
    for k in range(5):
        both = changed[k] + removed[k]
        columns.append(F.sum(F.when(mode == "A", added[k]).when(mode == "M", both).when(mode == "D", removed[k]).otherwise(0.0)).alias(f"l{k}"))
    known = changes.where(F.col("path").isNotNull()).select(F.coalesce("repo", F.lit("")).alias("repo"), "path", "mode", "insertions", "removals")
    return known.groupBy("repo", "path").agg(*columns)


# ---------------------------------------------------------------- content

_GENERATED_NOTE = re.compile(rb"(?i)@generated\b|code generated by|auto-?generated (file|by|from|code)|<auto-?generated|automatically (generated|produced|created)|automatisch (erzeugt|generiert)|this file (is|was) (auto(matically)?[ -]?)?(generated|produced)|g[e\xc3][\xa9n]?n[e\xc3]\xa9?r[e\xc3]\xa9? automatiquement|generado autom|machine[- ]generated")
_VENDORED_NOTE = re.compile(rb"(?i)bundled copy of|vendored from|upstream sources? imported")
#: Notices of two parts in one line, however far apart: the first place of the first part, then the second part anywhere after it.
_GENERATED_PARTS = ((re.compile(rb"(?i)generated (by|from|with) "), re.compile(rb"(?i)do not|don't|edit")), (re.compile(rb"(?i)do not (edit|modify)"), re.compile(rb"(?i)generated|by hand")))
_VENDORED_PARTS = ((re.compile(rb"(?i)vendored copy of "), re.compile(rb"(?i)release|version|v\d")), (re.compile(rb"(?i)imported (unmodified )?from "), re.compile(rb"(?i)release|upstream|version")), (re.compile(rb"(?i)copied (verbatim |unmodified )?from "), re.compile(rb"(?i)release|upstream|project|version")))
_NUMBERS = re.compile(rb"^[\s0-9a-fA-FxX,.+\-;{}\[\]()'\"\\uULl]*$")
#: Every alternative of the two patterns holds one of these.
_HINTS = (b"generat", b"generad", b"produced", b"vendored", b"bundled", b"upstream", b"automati", b"copied", b"imported", b"modify", b"edit")
_CODE_LINE = 400


def _bytes(content: bytes) -> bytes:
    """Text as UTF-8 or Latin-1 bytes; two-byte encodings are brought to one."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", "replace").encode("utf-8", "replace")
    return content


def _noted(text: bytes, pattern: re.Pattern, parts) -> bool:
    if pattern.search(text):
        return True
    for first, second in parts:
        at = 0
        while m := first.search(text, at):
            end = text.find(b"\n", m.end())
            end = len(text) if end < 0 else end
            if second.search(text, m.end(), end):
                return True
            at = end
    return False


def content_flags(content: bytes | None, web: bool = True) -> tuple[bool, bool, bool, bool]:
    """(generated, vendored, minified, numbers) as the content shows it; all false for none."""
    if not content:
        return False, False, False, False
    text = _bytes(content)
    low = text.lower()
    hinted = any(h in low for h in _HINTS)
    generated = hinted and _noted(text, _GENERATED_NOTE, _GENERATED_PARTS)
    vendored = hinted and _noted(text, _VENDORED_NOTE, _VENDORED_PARTS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    longest = max(map(len, lines), default=0)
    minified = False
    if longest >= _CODE_LINE and web:
        dense = sum(len(x) for x in lines if len(x) >= _CODE_LINE and x.count(b" ") * 8 < len(x) and sum(map(x.count, (b";", b"{", b"}", b"(", b","))) * 30 > len(x))
        minified = dense * 2 > len(text)
    numbers = False
    if len(lines) >= 5:
        digits = sum(len(x) for x in lines if len(x) > 15 and _NUMBERS.match(x) and sum(c in b"0123456789" for c in x) * 4 > len(x))
        numbers = digits * 10 > 6 * len(text)
    return generated, vendored, minified, numbers


_FLAGS = ("generated", "vendored", "minified", "numbers")


def _read_contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    web = re.compile(WEB_TYPES)
    for b in batches:
        flags = [content_flags(bytes(c) if c is not None else None, web.search(p) is not None) for p, c in zip(b["path"], b["content"], strict=True)]
        frame = b.drop(columns="content")
        for k, name in enumerate(_FLAGS):
            frame[name] = np.array([f[k] for f in flags], dtype=bool)
        yield frame[frame[list(_FLAGS)].any(axis=1)]


def content_signs(diffs: DataFrame) -> DataFrame:
    """``repo, path, mode, insertions, removals`` and a flag for each sign, for the changes whose stored content shows any."""
    each = diffs.select(F.coalesce("repo", F.lit("")).alias("repo"), F.explode("diff_changes").alias("c")).select("repo", F.col("c.location").alias("path"), F.col("c.kind").alias("mode"), F.col("c.insertions").alias("insertions"), F.col("c.removals").alias("removals"), F.col("c.content").alias("content"))
    each = spread(each.where(F.col("content").isNotNull() & F.col("path").isNotNull()))
    return each.mapInPandas(_read_contents, "repo string, path string, mode string, insertions int, removals int, " + ", ".join(f"{f} boolean" for f in _FLAGS))


def content_evidence(signs: DataFrame) -> DataFrame:
    """``repo, path, l0..l4`` for the files of which some stored content shows what they are."""
    strong = 14.0
    any_of = signs.groupBy("repo", "path").agg(*(F.max(c).alias(c) for c in _FLAGS))
    zero = F.lit(0.0)
    return any_of.select("repo", "path", zero.alias("l0"), *(F.when(F.col(c), strong).otherwise(0.0).alias(f"l{k}") for k, c in ((1, "generated"), (2, "minified"), (3, "vendored"), (4, "numbers"))))


# ---------------------------------------------------------------- names


def _name_evidence(path: Column) -> list[Column]:
    name = F.element_at(F.split(path, "/"), -1)
    web = path.rlike(WEB_TYPES)
    built = path.rlike(r"(?i)(^|/)(dist|out|build)/") & path.rlike(r"(?i)\.(js|mjs|cjs|css)$")
    generated = F.when(name.rlike(LOCK_NAMES) | name.rlike(GENERATED_NAMES), 12.0).when(built, 4.0).otherwise(0.0)
    minified = F.when(name.rlike(MINIFIED_NAMES), 12.0).when(web, 0.0).otherwise(-8.0)
    return [F.lit(0.0), generated, minified, F.lit(0.0), F.lit(0.0)]


def _dir_prior(path: Column) -> Column:
    last = F.lower(F.element_at(F.split(path, "/"), -1))
    vendor, made, maybe = last.isin(*VENDOR_DIRS), last.isin(*GENERATED_DIRS), last.isin(*MAYBE_DIRS)
    # A directory named like its content is presumed so whatever its parent is.
    return F.array(
        F.when(vendor | made, -6.0).when(maybe, 0.0).otherwise(0.5),
        F.when(made, 3.0).when(maybe, 1.0).otherwise(0.0),
        F.when(maybe, 0.5).otherwise(0.0),
        F.when(vendor, 6.0).otherwise(0.0),
        F.lit(0.0),
    )


# ---------------------------------------------------------------- belief propagation


def _message(belief: Column, upward: bool) -> Column:
    """log of COMPATIBLE times exp(belief), stabilised by the largest belief."""
    top = F.greatest(*(belief[k] for k in range(5)))
    e = [F.exp(belief[k] - top) for k in range(5)]
    rows = []
    for x in range(5):
        weights = [COMPATIBLE[x][c] if upward else COMPATIBLE[c][x] for c in range(5)]
        rows.append(F.log(sum((e[c] * weights[c] for c in range(1, 5)), e[0] * weights[0])) + top)
    return F.array(*rows)


def _plus(a: Column, b: Column) -> Column:
    return F.array(*(a[k] + b[k] for k in range(5)))


def _minus(a: Column, b: Column) -> Column:
    return F.array(*(a[k] - b[k] for k in range(5)))


def _sum_arrays(column: str, out: str) -> Column:
    return F.array(*(F.sum(F.col(column)[k]) for k in range(5))).alias(out)




def _array_message(belief: np.ndarray, upward: bool) -> np.ndarray:
    top = belief.max(axis=1, keepdims=True)
    table = np.array(COMPATIBLE)
    return np.log(np.exp(belief - top) @ (table.T if upward else table)) + top


def _trees(flush: int = 100_000):
    """Beliefs of the directories of whole repositories; rows of a repository are contiguous and in order of depth."""

    def solve(repos: np.ndarray, b: pd.DataFrame) -> pd.DataFrame:
        node = {k: i for i, k in enumerate(zip(repos, b["dir"], strict=True))}
        depth = b["depth"].to_numpy()
        parent = np.array([-1 if d == 0 else node[r, p] for r, p, d in zip(repos, b["parent"], depth, strict=True)], dtype=np.int64)
        own = np.stack(b["own"].to_numpy()).astype(np.float64)
        silent = b["silent"].to_numpy(dtype=bool)
        levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]
        sent = np.zeros_like(own)
        for at in levels[:0:-1]:
            sent[at] = np.where(silent[at, None], 0.0, _array_message(own[at], True))
            np.add.at(own, parent[at], sent[at])
        for at in levels[1:]:
            own[at] += _array_message(own[parent[at]] - sent[at], False)
        return pd.DataFrame({"repo": repos, "dir": b["dir"], "all": list(own)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            if not len(b):
                continue
            last = b["repo"].iloc[-1]
            if size and size + len(b) > flush:
                # Repositories that have ended are worked out; the last one may go on.
                rows = pd.concat([*held, b], ignore_index=True)
                open_ = (rows["repo"] == last).to_numpy()
                if not open_.all():
                    done = rows[~open_].reset_index(drop=True)
                    yield solve(done["repo"].to_numpy(), done)
                held, size = [rows[open_]], int(open_.sum())
            else:
                held.append(b)
                size += len(b)
        if size:
            rows = pd.concat(held, ignore_index=True)
            yield solve(rows["repo"].to_numpy(), rows)

    return run


def _by_levels(dirs: DataFrame) -> DataFrame:
    """The same, one pass up and one down, level by level: for trees of any size."""
    nil = F.array(*(F.lit(0.0) for _ in range(5)))
    deepest = dirs.agg(F.max("depth")).first()[0]
    up: dict[int, DataFrame] = {}
    below = None
    for d in range(deepest, -1, -1):
        level = dirs.where(F.col("depth") == d)
        if below is not None:
            told = below.groupBy("repo", F.col("parent").alias("dir")).agg(_sum_arrays("sent", "told"))
            level = level.join(told, ["repo", "dir"], "left").withColumn("own", _plus(F.col("own"), F.coalesce("told", nil))).drop("told")
        below = up[d] = cut(level.withColumn("sent", F.when(F.col("silent"), nil).otherwise(_message(F.col("own"), True))))
    known = up[0].select("repo", "dir", F.col("own").alias("all"))
    everything = known
    for d in range(1, deepest + 1):
        above = known.withColumnRenamed("dir", "parent").withColumnRenamed("all", "above")
        level = up[d].join(above, ["repo", "parent"])
        level = level.withColumn("cavity", _minus(F.col("above"), F.col("sent"))).withColumn("down", _message(F.col("cavity"), False))
        known = cut(level.select("repo", "dir", _plus(F.col("own"), F.col("down")).alias("all")))
        everything = everything.unionByName(known)
    return everything


def labels(changes: DataFrame, diffs: DataFrame | None = None, whole_tree: int = 200_000) -> DataFrame:
    """``repo, path, label, certainty`` for every file of ``changes``.

    * Rows with a null path belong to no file; a null repo is a repository of its own (``''``).
    * Null counts and unknown modes are no evidence; negative counts read as 0.
    * Repeated rows add evidence, never change the direction of it; ties go to the earlier label.
    * Empty tables give an empty result; further columns are not read.
    """
    nil = F.array(*(F.lit(0.0) for _ in range(5)))
    signs = flagged = None
    if diffs is not None:
        signs = written(content_signs(diffs), "signs")
        settled = F.when(F.col("numbers"), 4).when(F.col("minified"), 2).when(F.col("vendored"), 3).when(F.col("generated"), 1)
        flagged = signs.select(settled.alias("label"), "mode", F.col("insertions").cast("bigint").alias("insertions"), F.col("removals").cast("bigint").alias("removals"))
    files = change_evidence(changes, learned_sizes(changes, flagged))
    if signs is not None:
        # Evidence of content joins in the same aggregation: a union, not a join.
        seen = files.withColumn("__known", F.lit(True)).unionByName(content_evidence(signs).withColumn("__known", F.lit(False)))
        files = seen.groupBy("repo", "path").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(5)), F.max("__known").alias("__known")).where("__known").drop("__known")
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    names = _name_evidence(F.col("path"))
    files = files.select("repo", "path", F.array_join(F.slice(parts, F.lit(1), depth), "/").alias("dir"), F.array(*(F.col(f"l{k}") + names[k] for k in range(5))).alias("l"))
    # Each message is a column of its own before it is used: an expression used five times would be computed five times.
    # A lock file lies beside any kind of code and says nothing of its directory: its message is flat.
    lock = F.element_at(F.split("path", "/"), -1).rlike(LOCK_NAMES)
    files = written(files.withColumn("m", F.when(lock, nil).otherwise(_message(F.col("l"), True))), "files")
    from_files = written(files.groupBy("repo", "dir").agg(_sum_arrays("m", "own"), F.count(F.lit(1)).alias("n")), "directories")
    # Every directory and its ancestors; depth 0 is the root of a repository.
    split = F.split("dir", "/")
    up_to = F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(split)))
    named = from_files.select("repo", F.explode(F.transform(up_to, lambda k: F.array_join(F.slice(split, F.lit(1), k), "/"))).alias("dir"), nil.alias("own"))
    dirs = named.unionByName(from_files.select("repo", "dir", "own")).groupBy("repo", "dir").agg(_sum_arrays("own", "own"))
    n_parts = F.when(F.col("dir") == "", 0).otherwise(F.size(split))
    prior = F.when(F.col("dir") == "", F.array(F.lit(3.0), *(F.lit(0.0) for _ in range(4)))).otherwise(_dir_prior(F.col("dir")))
    parent = F.when(F.col("dir") == "", F.lit(None)).otherwise(F.array_join(F.slice(split, F.lit(1), F.greatest(n_parts - 1, F.lit(0))), "/"))
    # A directory named for its content lies in any parent and says nothing of it.
    silent = F.lower(F.element_at(F.split("dir", "/"), -1)).isin(*VENDOR_DIRS, *GENERATED_DIRS)
    dirs = written(dirs.select("repo", "dir", n_parts.alias("depth"), parent.alias("parent"), silent.alias("silent"), _plus(prior, F.col("own")).alias("own")), "tree")
    sizes = dirs.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    # Each has more than ``whole_tree`` of all directories: a short list.
    large = [r["repo"] for r in sizes.where(F.col("n") > whole_tree).select("repo").collect()]
    small = dirs.where(~F.col("repo").isin(large)) if large else dirs
    everything = small.repartition("repo").sortWithinPartitions("repo", "depth").mapInPandas(_trees(), "repo string, dir string, all array<double>")
    if large:
        everything = everything.unionByName(_by_levels(dirs.where(F.col("repo").isin(large))))
    told = hot_join(files, everything, ["repo", "dir"], counts=from_files.select("repo", "dir", "n")).select("repo", "path", "l", _minus(F.col("all"), F.col("m")).alias("cavity"))
    told = told.select("repo", "path", "l", _message(F.col("cavity"), False).alias("down"))
    told = told.select("repo", "path", *((F.col("l")[k] + F.col("down")[k]).alias(f"b{k}") for k in range(5)))
    told = told.withColumn("top", F.greatest(*(F.col(f"b{k}") for k in range(5))))
    label = F.lit(LABELS[4])
    for k in (3, 2, 1, 0):
        label = F.when(F.col(f"b{k}") == F.col("top"), LABELS[k]).otherwise(label)
    mass = F.exp(F.col("b0") - F.col("top"))
    for k in range(1, 5):
        mass = mass + F.exp(F.col(f"b{k}") - F.col("top"))
    return told.select("repo", "path", label.alias("label"), (1 / mass).alias("certainty"))


def touched(changes: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of ``changes`` whose file is not handwritten, with its label.

    Labels are one row per file; the rows of a file with very many changes are spread over many tasks.
    """
    other = labelled.where(F.col("label") != "handwritten").select("repo", "path", "label")
    keyed = changes.where(F.col("path").isNotNull()).withColumn("repo", F.coalesce("repo", F.lit("")))
    return hot_join(keyed, other, ["repo", "path"])
