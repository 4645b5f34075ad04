"""Preference pairs by plain Python: prefixes of none, some and all turns, masks, and long conversations."""

from conftest import DATA
from pyspark.sql import functions as F

from joblattice.llm import preference


def rendered(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}\n" for r, t in turns)


def mask(turns):
    out, at = [], 0
    for r, t in turns:
        if r == "assistant":
            out.append((at + len(r) + 5, len(t or "")))
        at += len(rendered([(r, t)]))
    return out


def formatted(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    return (n, rendered(chosen[:n]), rendered(chosen[n:]), rendered(rejected[n:]), mask(chosen[n:]), mask(rejected[n:]))


def pairs(rows):
    order = lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or "", t[2] is not None, t[2] or "")
    by = {}
    for conv, *turn in rows:
        by.setdefault(conv, []).append(turn)
    by = {c: [(r, t) for _, r, t in sorted(ts, key=order)] for c, ts in by.items()}
    last = {c: max((i for i, (r, _) in enumerate(ts) if r == "assistant"), default=None) for c, ts in by.items()}
    out = {}
    for c, ts in by.items():
        other = None if c is None else c ^ 1
        answer = [by[other][last[other]]] if other is not None and other in by and last[other] is not None else []
        out[c] = formatted(ts, ts if last[c] is None else ts[: last[c]] + answer)
    return out


def got_of(df):
    spans = lambda m: [(s.start, s.length) for s in m]
    return {r.pair_id: (r.n_prompt_turns, r.prompt, r.chosen, r.rejected, spans(r.chosen_mask), spans(r.rejected_mask)) for r in df.collect()}


def test_pairs_by_answer(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(10**6, 0, "user", "q"), (10**6 + 1, 0, "assistant", "x"), (10**6 + 2, 0, None, None), (None, 0, "user", "n"), (None, 1, "assistant", None), (None, 1, "assistant", None), (10**6 + 4, 3, "assistant", "b"), (10**6 + 4, 3, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit("clash"))
    got = got_of(preference.format_pairs(preference.pair_by_answer(df)))
    assert got == pairs(rows)
    kinds = {("none" if not n else "all" if not c and not r else "some") for n, _, c, r, _, _ in got.values()}
    assert kinds == {"none", "some", "all"}
    assert preference.format_pairs(preference.pair_by_answer(df.where("false"))).count() == 0


def test_masks_of_a_long_conversation(spark):
    rows = [(0, i, ("user", "assistant")[i % 2], "é" * (i % 7)) for i in range(1500)] + [(1, 1, "assistant", "other")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = preference.format_pairs(preference.pair_by_answer(df).withColumn("chosen", F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit("s").alias("text"))), "chosen")))
    chosen = [("system", "s")] + [r[2:] for r in rows[:1500]]
    assert got_of(got)[0] == formatted(chosen, [r[2:] for r in rows[:1499]] + [("assistant", "other")])
