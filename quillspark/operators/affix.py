"""Affix rules: expansion of flagged roots, inverse rules, joint entries, minimal root lists.

rules: DataFrame of kind (PFX, SFX), flag, cross (boolean), strip, append, cond (a regular expression without anchors).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.storage import stage

RULES = "kind string, flag string, cross boolean, strip string, append string, cond string"


def parse_affix(lines: list[str] | str) -> list[tuple[str, str, bool, str, str, str]]:
    """Rules of ``PFX/SFX flag Y|N count`` blocks with ``strip append cond`` rows; 0 stands for nothing."""
    out, cross = [], {}
    for line in lines.splitlines() if isinstance(lines, str) else lines:
        p = line.split("#", 1)[0].split()
        if not p or p[0] not in ("PFX", "SFX"):
            continue
        if len(p) == 4 and p[2] in "YN" and p[3].isdigit() and (p[0], p[1]) not in cross:
            cross[p[0], p[1]] = p[2] == "Y"
        elif len(p) >= 4:
            strip, append = ("" if x == "0" else x for x in p[2:4])
            cond = p[4] if len(p) > 4 else "."
            out.append((p[0], p[1], cross.get((p[0], p[1]), False), strip, append.split("/")[0], "" if cond == "." else cond))
        else:
            raise ValueError(f"not an affix rule: {line!r}")
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of an affix file as they stand."""
    return spark.read.text(path)


def rule_lines(affixes: DataFrame) -> list[str]:
    """An affix file of rules: what parse_affix() reads."""
    blocks: dict[tuple[str, str, bool], list[str]] = {}
    for r in affixes.orderBy("kind", "flag", "append", "strip", "cond").collect():  # as many as an affix file has
        blocks.setdefault((r["kind"], r["flag"], r["cross"]), []).append(f"{r['kind']} {r['flag']} {r['strip'] or 0} {r['append'] or 0} {r['cond'] or '.'}")
    return [line for (kind, flag, cross), own in blocks.items() for line in (f"{kind} {flag} {'Y' if cross else 'N'} {len(own)}", *own)]


def rules(spark: SparkSession, lines: list[str] | str) -> DataFrame:
    return spark.createDataFrame(parse_affix(lines), RULES)


def _applied(word: Column) -> Column:
    """The form a rule makes of a word, null where it does not apply."""
    n, s = F.length(word), F.length("strip")
    suffix = F.when((n > s) & F.endswith(word, F.col("strip")) & F.regexp_like(word, F.concat(F.lit("("), F.col("cond"), F.lit(")$"))), F.concat(F.substring(word, F.lit(1), n - s), F.col("append")))
    prefix = F.when((n > s) & F.startswith(word, F.col("strip")) & F.regexp_like(word, F.concat(F.lit("^("), F.col("cond"), F.lit(")"))), F.concat(F.col("append"), word.substr(s + 1, n)))
    return F.when(F.col("kind") == "SFX", suffix).otherwise(prefix)


def expand(words: DataFrame, affixes: DataFrame) -> DataFrame:
    """word, aff, form, prefix, suffix: the root itself and all forms its flags make; suffixes go on prefixed roots where both rules allow it.

    Conditions of suffixes are tested on the root. Rules are few: they are joined by flag."""
    flags = words.select("word", "aff", F.explode(F.array_distinct(F.split("aff", ""))).alias("flag")).where("flag <> ''")
    made = flags.join(affixes, "flag").withColumn("form", _applied(F.col("word"))).where("form is not null")
    single = made.select("word", "aff", "form", F.when(F.col("kind") == "PFX", F.col("flag")).alias("prefix"), F.when(F.col("kind") == "SFX", F.col("flag")).alias("suffix"))
    pre = made.where("kind = 'PFX' and cross").select("word", "aff", "flag", F.col("append").alias("p_add"), F.length("strip").alias("p_cut"))
    suf = made.where("kind = 'SFX' and cross").select("word", "aff", F.col("flag").alias("s_flag"), "form")
    both = pre.join(suf, ["word", "aff"]).select("word", "aff", F.concat("p_add", F.col("form").substr(F.col("p_cut") + 1, F.length("form"))).alias("form"), F.col("flag").alias("prefix"), F.col("s_flag").alias("suffix"))
    none = F.lit(None).cast("string")
    return words.select("word", "aff", F.col("word").alias("form"), none.alias("prefix"), none.alias("suffix")).unionByName(single).unionByName(both).distinct()


def expanded_lines(words: DataFrame, affixes: DataFrame, level: int = 1) -> DataFrame:
    """Level 1: the forms of a root in one line; 2: root and forms; 3: a line for each form; 4: with the ratio of lengths."""
    forms = expand(words, affixes).select("word", "aff", "form").distinct()
    root = F.when(F.col("aff") == "", F.col("word")).otherwise(F.concat_ws("/", "word", "aff"))
    if level in (3, 4):
        rows = forms.select(root.alias("root"), "form", "word")
        if level == 3:
            return rows.select(F.concat_ws(" ", "root", "form").alias("line"))
        ratio = (F.sum(F.length("form")).over(Window.partitionBy("root")) / F.length("word")).alias("ratio")
        return rows.select(F.concat_ws(" ", "root", "form").alias("line"), F.round(ratio, 6).alias("ratio"))
    grouped = forms.groupBy("word", "aff").agg(F.sort_array(F.collect_set("form")).alias("forms"))
    line = F.array_join("forms", " ")
    return grouped.select((line if level == 1 else F.concat_ws(" ", root, line)).alias("line"))


def munch(words: DataFrame, affixes: DataFrame, word: str = "word") -> DataFrame:
    """word, root, prefix, suffix: all roots that one rule, or a prefix and a suffix that cross, could have made the word from.

    Words in capitals have none; words with a first capital have no prefixes. Rules are joined by the letters they add:
    a word meets only the rules whose affix it ends or starts with."""
    w = F.col("word")
    rows = words.select(F.col(word).alias("word")).distinct().where((w != F.upper(w)) | (w == F.lower(w)))
    first = F.substring("word", 1, 1)
    lower_first = first == F.lower(first)
    # the ends of a word of the lengths that the rules add are its keys: as many as an affix file has lengths
    added = sorted(r[0] for r in affixes.select(F.length("append")).distinct().collect())
    lengths = F.filter(F.array(*[F.lit(n) for n in added]).cast("array<int>"), lambda n: n < F.length("word"))
    ends = rows.where(F.length("word") > 1).select("word", F.explode(lengths).alias("k")).select("word", "k", F.substring("word", F.length("word") - F.col("k") + 1, F.col("k")).alias("_key"))
    heads = rows.where(F.length("word") > 1).where(lower_first).select("word", F.explode(lengths).alias("k")).select("word", "k", F.substring("word", F.lit(1), F.col("k")).alias("_key"))

    def undone(keys: DataFrame, kind: str) -> DataFrame:
        r = affixes.where(F.col("kind") == kind).withColumn("_key", F.col("append"))
        joined = keys.join(r, "_key")
        stem = F.substring("word", F.lit(1), F.length("word") - F.col("k")) if kind == "SFX" else F.col("word").substr(F.col("k") + 1, F.length("word"))
        root = F.concat(stem, F.col("strip")) if kind == "SFX" else F.concat(F.col("strip"), stem)
        again = joined.withColumn("root", root).withColumn("_again", _applied(F.col("root")))
        return again.where(F.col("_again") == F.col("word")).select("word", "root", "flag", "cross")

    suffixed, prefixed = undone(ends, "SFX"), undone(heads, "PFX")
    none = F.lit(None).cast("string")
    out = suffixed.select("word", "root", none.alias("prefix"), F.col("flag").alias("suffix")).unionByName(prefixed.select("word", "root", F.col("flag").alias("prefix"), none.alias("suffix")))
    # word = prefix + (suffixed root): undo the prefix, then the suffix of what is left
    middle = prefixed.where("cross").select(F.col("word").alias("outer"), F.col("root").alias("word"), F.col("flag").alias("prefix"))
    inner = middle.select("word").distinct()
    inner_ends = inner.where(F.length("word") > 1).select("word", F.explode(lengths).alias("k")).select("word", "k", F.substring("word", F.length("word") - F.col("k") + 1, F.col("k")).alias("_key"))
    crossed = undone(inner_ends, "SFX").where("cross").join(middle, "word").select(F.col("outer").alias("word"), "root", "prefix", F.col("flag").alias("suffix"))
    return out.unionByName(crossed).distinct()


def affix_correct(words: DataFrame, dictionary: DataFrame, affixes: DataFrame, word: str = "word") -> DataFrame:
    """word, root, prefix, suffix where a dictionary entry (word, aff) has the flags that make the word; case is lowered first where needed."""
    tried = words.select(F.col(word).alias("word")).distinct()
    lowered = tried.select(F.col("word").alias("typed"), F.explode(F.array_distinct(F.array(F.col("word"), F.lower("word"), F.concat(F.lower(F.substring("word", 1, 1)), F.col("word").substr(F.lit(2), F.length("word")))))).alias("word"))
    entries = dictionary.select(F.col("word").alias("root"), F.col("aff").alias("_aff"))
    found = munch(lowered.select("word"), affixes).join(entries, "root")
    has = lambda c: F.col(c).isNull() | F.contains(F.col("_aff"), F.col(c))
    return found.where(has("prefix") & has("suffix")).join(lowered, "word").select(F.col("typed").alias("word"), "root", "prefix", "suffix").distinct()


def valid_flags(words: DataFrame, affixes: DataFrame) -> DataFrame:
    """word, flag, verdict: Valid, Inapplicable (no rule of the flag fits the word) or Invalid (no such flag)."""
    flags = words.select("word", F.explode(F.array_distinct(F.split("aff", ""))).alias("flag")).where("flag <> ''")
    joined = flags.join(affixes.withColumn("_known", F.lit(True)), "flag", "left")
    verdict = F.when(F.max("_known").isNull(), "Invalid").when(F.max(_applied(F.col("word")).isNotNull()), "Valid").otherwise("Inapplicable")
    return joined.groupBy("word", "flag").agg(verdict.alias("verdict"))


def combine(words: DataFrame) -> DataFrame:
    """Entries equal but for case become one: flags united, the lower-case form rather than another."""
    flags = F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.split("aff", ""))))), "")
    best = F.min(F.struct((F.col("word") != F.lower("word")).alias("upper"), "word")).alias("x")
    return words.groupBy(F.lower("word").alias("_key")).agg(best, flags.alias("aff")).select("x.word", "aff")


def munch_list_simple(words: DataFrame, affixes: DataFrame) -> DataFrame:
    """word, aff: each word under its shortest root in the list whose flag makes only words of the list.

    A root takes the flags of all words that chose it, itself included; the choice does not depend on input order."""
    own = words.select("word").distinct()
    candidates = munch(own, affixes).join(own.withColumnRenamed("word", "root"), "root", "left_semi")
    roots = candidates.select(F.col("root").alias("word"), F.explode(F.filter(F.array("prefix", "suffix"), lambda x: x.isNotNull())).alias("aff")).distinct()
    made = expand(roots, affixes).where("form <> word").select("word", "aff", "form").distinct()
    bad = made.join(own.withColumnRenamed("word", "form"), "form", "left_anti").select(F.col("word").alias("root"), F.col("aff").alias("flag")).distinct()
    single = candidates.where("prefix is null or suffix is null").withColumn("flag", F.coalesce("prefix", "suffix"))
    good = single.join(bad, ["root", "flag"], "left_anti")
    choice = good.groupBy("word").agg(F.min(F.struct(F.length("root").alias("n"), "root", "flag")).alias("x")).select("word", "x.root", "x.flag")
    # a root that is itself made from another one stays a root of its own words
    kept = own.join(choice.select("word"), "word", "left_anti").select("word").unionByName(choice.select(F.col("root").alias("word"))).distinct()
    flags = choice.groupBy("root").agg(F.array_join(F.sort_array(F.collect_set("flag")), "").alias("aff"))
    return kept.join(flags.withColumnRenamed("root", "word"), "word", "left").select("word", F.coalesce("aff", F.lit("")).alias("aff"))


def set_cover(sets: dict[str, set[str]]) -> dict[str, set[str]]:
    """Chosen names, each with what it is the first to cover. All sets together are covered.

    Until nothing is left: sets that lie in another go, sets that alone have an element are taken; if neither happens,
    the largest is taken, of several the first by name. What is covered then counts no more."""
    left = {k: set(v) for k, v in sets.items() if v}
    owners: dict[str, set[str]] = {}
    for name, own in left.items():
        for x in own:
            owners.setdefault(x, set()).add(name)
    chosen: dict[str, set[str]] = {}

    def drop(name: str) -> None:
        for x in left.pop(name):
            owners[x].discard(name)

    def take(name: str) -> None:
        gain = chosen[name] = set(left[name])
        for x in gain:
            for other in owners.pop(x):
                left[other].discard(x)
        left.pop(name)

    open_ = sorted(left)
    while left:
        before = len(left)
        # only a set that shares its rarest element can hold another one
        for name in sorted(open_, key=lambda n: (len(left.get(n, ())), n)):
            own = left.get(name)
            if own is None:
                continue
            if not own or any(other != name and own <= left[other] for other in owners[min(own, key=lambda x: (len(owners[x]), x))]):
                drop(name)
        for name in sorted(left):
            if name in left and any(len(owners[x]) == 1 for x in left[name]):
                take(name)
        if left and len(left) == before:
            take(min(left, key=lambda n: (-len(left[n]), n)))
        open_ = list(left)
    return chosen


def munch_list(words: DataFrame, affixes: DataFrame) -> DataFrame:
    """word, aff: a small set of flagged roots whose expansion is the list, by set cover in each connected part.

    Roots and the words they make are linked; each connected part is covered on its own, in one task: a part holds
    words that affixes make of each other, not more with more words of other roots."""
    from pyspark.sql import types as T

    own = words.select("word").distinct()
    candidates = munch(own, affixes).join(own.withColumnRenamed("word", "root"), "root", "left_semi")
    each = candidates.select("root", F.explode(F.filter(F.array("prefix", "suffix"), lambda x: x.isNotNull())).alias("flag")).distinct()
    made = expand(each.select(F.col("root").alias("word"), F.col("flag").alias("aff")), affixes).where("form <> word").select(F.col("word").alias("root"), F.col("aff").alias("flag"), "form").distinct()
    bad = made.join(own.withColumnRenamed("word", "form"), "form", "left_anti").select("root", "flag").distinct()
    good = made.join(bad, ["root", "flag"], "left_anti")
    labels = word_components(good.select(F.col("root").alias("a"), F.col("form").alias("b")))
    rows = good.join(labels.withColumnRenamed("node", "root"), "root").select("component", "root", "flag", "form")

    def cover(pdf):
        import pandas as pd

        flags: dict[str, dict[str, set[str]]] = {}
        for root, flag, form in zip(pdf["root"], pdf["flag"], pdf["form"], strict=True):
            flags.setdefault(root, {}).setdefault(flag, set()).add(form)
        out = []
        for root, gain in set_cover({r: {r}.union(*own.values()) for r, own in flags.items()}).items():
            used, rest = "", gain - {root}
            for flag in sorted(flags[root], key=lambda f: (-len(flags[root][f]), f)):
                if flags[root][flag] & rest:
                    used, rest = used + flag, rest - flags[root][flag]
            out.append((root, "".join(sorted(used))))
        return pd.DataFrame(out, columns=["word", "aff"])

    covered = rows.groupBy("component").applyInPandas(cover, T.StructType([T.StructField("word", T.StringType()), T.StructField("aff", T.StringType())]))
    alone = own.join(labels.select(F.col("node").alias("word")), "word", "left_anti").select("word", F.lit("").alias("aff"))
    return covered.unionByName(alone)


def word_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component: the least node that each node of edges (a, b) is linked with, by repeated least neighbours.

    Lineage is cut by tables in the shared folder."""
    both = edges.where("a <> b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stage(both, "words")
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "words")
    for _ in range(rounds):
        around = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        near = labels.join(around, labels["node"] == around["a"]).select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        # and on to the component's own component: paths halve
        jump = near.join(labels.select(F.col("node").alias("component"), F.col("component").alias("next")), "component", "left").select("node", F.least("component", F.coalesce("next", "component")).alias("component"), "old")
        new = stage(jump, "words")
        if new.where("component <> old").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
