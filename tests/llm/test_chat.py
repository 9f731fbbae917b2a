import random

from quadrille.llm.chat import Template, preference_pairs


def brute(turns, pairs):
    order = lambda c: [(r or "", t or "") for _, _, r, t in sorted((x for x in turns if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
    out = {}
    for p, a, b in pairs:
        if None in (p, a, b):
            continue
        x, y = order(a), order(b)
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        text = lambda ts: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in ts)

        def mask(ts):
            at, spans = 0, []
            for r, t in ts:
                begin = at + len(f"<|{r}|>\n")
                at = begin + len(t) + len("<|end|>\n")
                if r == "assistant":
                    spans.append((begin, at))
            return spans

        out[p] = (a, b, n, text(x[:n]), text(x[n:]), text(y[n:]), mask(x[n:]), mask(y[n:]))
    return out


def test_pairs_match_brute_force(spark):
    rng = random.Random(5)
    turns = []
    for c in range(30):
        for t in range(rng.randrange(0, 7)):
            turns.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "hello", "", None, "é" * 3])))
    turns += [(31, None, "system", "s"), (31, 0, None, "x"), (31, 0, None, "x"), (32, None, "system", "s"), (32, 0, "", "x"), (None, 0, "user", "hi"), (33, 0, "assistant", "long " * 3000)]
    pairs = [(i, rng.randrange(34), rng.randrange(34)) for i in range(60)] + [(100, 31, 32), (101, 33, 33), (102, 500, 501), (103, None, 1), (None, 1, 2)]
    frame = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn int, role string, text string, prompt string")
    got = preference_pairs(frame, spark.createDataFrame(pairs, "pair_id long, chosen_id long, rejected_id long"), Template())
    rows = {r.pair_id: (r.chosen_id, r.rejected_id, r.n_common, r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_mask], [tuple(s) for s in r.rejected_mask]) for r in got.collect()}
    assert rows == brute(turns, pairs)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    empty = preference_pairs(frame.limit(0), spark.createDataFrame([(1, 1, 2)], "pair_id long, chosen_id long, rejected_id long")).collect()
    assert [(r.n_common, r.prompt, r.chosen, r.rejected) for r in empty] == [(0, "", "", "")]
