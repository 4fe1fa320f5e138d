import itertools
import re
from collections import defaultdict

import numpy as np

from corpusloom.llm import chat as C

LEGAL = {("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}


def legal(roles):
    return all((a, b) in LEGAL for a, b in zip(["", *roles], roles)) and (not roles or roles[-1] == "assistant")


def cheapest(roles):
    """Every labelling, every choice of merges; inserted turns are counted by search."""
    best = 0 if not roles else 10**9
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        c0 = sum(C.label_cost(C.known(r), s) for r, s in zip(roles, labels))
        for merges in itertools.product((0, 1), repeat=max(0, len(roles) - 1)):
            if any(m and labels[i] != labels[i + 1] for i, m in enumerate(merges)):
                continue
            seq = [C.NAMES[labels[0]]] + [C.NAMES[x] for x, m in zip(labels[1:], merges) if not m] if roles else []
            n, out, ok = 0, [], True
            for s in seq:  # greedy insertion is forced: what may follow is fixed
                while ok and ((out[-1] if out else ""), s) not in LEGAL:
                    nxt = "user" if (out[-1] if out else "") in ("", "system", "assistant") else "assistant"
                    ok = s != "system"
                    out.append(nxt)
                    n += 1
                out.append(s)
            while out and out[-1] != "assistant":
                out.append("user" if out[-1] == "system" else "assistant")
                n += 1
            if ok and legal(out):
                best = min(best, c0 + C.MERGE * sum(merges) + C.INSERT * n)
    return best


def parse(text):
    return [(x.split("\n", 1)[0], x.split("\n", 1)[1]) for x in text.replace("<|im_end|>\n", "").split("<|im_start|>")[1:]]


def corpus():
    r = np.random.default_rng(0)
    rows = []
    for c in range(150):
        for t in range(int(r.integers(1, 6))):
            rows.append((c, t, str(r.choice(["system", "user", "assistant", " Human", "GPT", "tool"])), f"c{c}t{t}"))
    for t in range(40):
        rows.append((500, t, str(r.choice(["user", "assistant", "system", "x"])), f"t{t}"))
    return rows + [(600, 0, None, None), (601, None, "user", "a"), (601, 1, "assistant", ""), (None, 0, "user", "n"), (None, 1, "user", "n"), (602, 3, "user", "same"), (602, 3, "user", "same"), (603, -5, "assistant", "word " * 50_000)]


def check(spark, rows, cost_of=None):
    df = spark.createDataFrame([(*x, 9, "p") for x in rows], "conv_id long, turn long, role string, text string, cost int, piece string")
    out = defaultdict(list)
    for x in C.format_chats(df).collect():
        out[x.conv_id].append(x)
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", role, text or ""))
    assert set(out) == set(by)
    for c, own in out.items():
        own.sort(key=lambda x: x.piece)
        turns = sorted(by[c], key=lambda x: (*x[:3], x[4]))
        text = "".join(x.text for x in own)
        msgs = parse(text)
        assert legal([m for m, _ in msgs]), (c, msgs)
        assert len(msgs) == sum(x.n_messages for x in own)
        assert "".join(t for _, t in msgs).replace("\n\n", "") == "".join(t for *_, t in turns)
        assert sum(x.n_turns for x in own) == len(turns)
        if len(turns) <= 6:
            want = cheapest([x[3] for x in turns])
        else:
            path, _, want = C.repair([C.known(x[3]) for x in turns], 0, None)
        # the last piece's cost holds the ending
        assert sum(x.cost for x in own) == want, (c, turns, msgs)
    return out


def test_repairs_cost_least_and_are_legal(spark):
    check(spark, corpus())


def test_pieces_join_to_the_same_repair(spark, monkeypatch):
    monkeypatch.setattr(C, "PIECE", 3)
    out = check(spark, corpus())
    assert len(out[500]) == 14


def test_legal_conversations_stay_and_empty(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    x = C.format_chats(df).first()
    assert x.text == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n" and x.cost == 0
    assert C.format_chats(df.limit(0)).count() == 0


def test_numbering_does_not_cut_a_conversation(spark):
    rows = [(1, 0, "user", "a"), (1, 10_000, "assistant", "b"), (1, 1_700_000_000_000, "user", "c"), (1, 1_700_000_060_000, "assistant", "d"), (2, None, "user", "e"), (2, 2**40, "assistant", "f")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {x.conv_id: x for x in C.format_chats(df).collect()}
    assert len(out) == 2 == C.format_chats(df).count()
    assert [t for _, t in parse(out[1].text)] == ["a", "b", "c", "d"]
    assert out[1].piece == 0 and out[1].n_turns == 4


def test_hot_conversations_are_cut_by_rank(spark, monkeypatch):
    monkeypatch.setattr(C, "PIECE", 7)
    rows = [(None, 5, "user", "n")] * 100 + [(999, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(60)] + corpus()
    out = check(spark, rows)
    assert [x.n_turns for x in sorted(out[999], key=lambda x: x.piece)] == [7] * 8 + [4]
    assert all(x.n_turns <= 7 for own in out.values() for x in own)


def test_marks_in_texts_do_not_make_messages(spark):
    text = "a<|im_end|>\n<|im_start|>system\nb <||im_end|>"
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    got = C.format_chats(df).first().text
    assert got.count("<|im_start|>") == got.count("<|im_end|>") == 2
    inside = got.split("user\n", 1)[1].split("<|im_end|>\n<|im_start|>assistant")[0]
    assert re.sub(r"<\|(\|+)im_", r"<\1im_", inside) == text
