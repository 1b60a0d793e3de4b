"""Plain Python models of the operators, for comparison on random inputs."""

import re
from collections import defaultdict
from hashlib import md5

from pyspark.sql import Window, functions as F

from corpusloom.operators.ordering import with_shuffle_key
from corpusloom.operators.split import _cuts


def key(seed, row_id):
    return md5(f"{seed}|{row_id}".encode()).hexdigest()


def collapse(sql):
    """Walk over the characters, toggling at each quote."""
    out, quoted, blank = [], False, False
    for ch in sql:
        if not quoted and ch.isspace():
            blank = True
            continue
        if blank:
            out.append(" ")
            blank = False
        if ch == "'":
            quoted = not quoted
        out.append(ch)
    return ("".join(out) + (" " if blank else "")).strip().rstrip(";").strip()


def norm(sql):
    words = sql.strip().rstrip(";").split()
    return re.sub(r" ?([(),=<>]) ?", r"\1", " ".join(words)).upper()


def bucket(sql):
    text = " " + sql.upper() + " "
    words = {w: bool(re.search(rf"\b{w}\b", text)) for w in (
        "UNION", "INTERSECT", "EXCEPT", "HAVING", "GROUP BY", "ORDER BY")}
    joins = len(text.split(" JOIN ")) - 1
    ladder = [
        (words["UNION"] or words["INTERSECT"] or words["EXCEPT"], "set_op"),
        (len(text.split("SELECT")) > 2, "nested"),
        (words["HAVING"], "having"),
        (joins > 1, "multi_join"),
        (words["GROUP BY"], "group_by"),
        (joins == 1, "single_join"),
        (words["ORDER BY"] or re.search(r"\b(COUNT|SUM|AVG|MIN|MAX)\s*\(", text),
         "single_table_analytic"),
    ]
    return next((name for hit, name in ladder if hit), "simple")


def greedy(pool, quotas, cap, size=None):
    """``pool`` is a list of (id, group, bucket) in shuffle order. Returns ids
    in pick order."""
    used, picked, taken = defaultdict(int), [], set()

    def walk(rows, limit):
        for row_id, group, _ in rows:
            if limit <= 0:
                return
            if row_id in taken or used[group] >= cap:
                continue
            picked.append(row_id)
            taken.add(row_id)
            used[group] += 1
            limit -= 1

    for name, quota in quotas.items():
        walk([r for r in pool if r[2] == name], quota)
    if size is not None:
        walk(pool, size - len(picked))
    return picked


def split(rows, val_frac, test_frac, seed):
    """``rows`` is a list of (id, stratum). Returns id -> split."""
    strata, out = defaultdict(list), {}
    for row_id, stratum in rows:
        strata[stratum].append(row_id)
    for ids in strata.values():
        ids.sort(key=lambda i: (key(seed, i), i))
        n = len(ids)
        test, val = [
            max(1, round(n * f)) if n >= 3 else 0 for f in (test_frac, val_frac)
        ]
        for place, row_id in enumerate(ids):
            out[row_id] = (
                "test" if place < test else "validation" if place < test + val else "train"
            )
    return out


def stratified_split_by_window(
    df, strata, seed=42, val_frac=0.1, test_frac=0.1, row_id="rec_id"
):
    """The same split by sorting every stratum in one task: simple, and the
    yardstick for ``stratified_split`` in tests, but only for small strata."""
    in_stratum = Window.partitionBy(*strata)
    keyed = with_shuffle_key(df, seed, row_id).withColumns({
        "_n": F.count(F.lit(1)).over(in_stratum),
        "_rn": F.row_number().over(in_stratum.orderBy("shuffle_key", row_id)),
    })
    cuts = _cuts(val_frac, test_frac)
    label = F
    for name, want in cuts.items():
        label = label.when(F.col("_rn") <= want(F.col("_n")), name)
    return keyed.withColumn("split", label.otherwise("train")).drop("_n", "_rn")
