import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import chat_format as C

PIECES = st.lists(st.sampled_from(["<", "|im_start|>", "<|im_end|>", "\\", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<s>", "[", "x", "\n", "<|endoftext|>", "|", "日"]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_escape_is_reversible(pieces):
    text = "".join(pieces)
    safe = C.escape(text)
    assert C.unescape(safe) == text
    for control in (C.OPEN, C.CLOSE, "</s>", "<s>", "[INST]", "[/INST]", "<|endoftext|>"):
        assert control not in safe
    assert C._unescape_role(C._escape_role(text)) == text and "\n" not in C._escape_role(text)


def rows():
    rng = random.Random(4)
    out = []
    for conv in range(25):
        if conv % 3 == 0:
            out.append((conv, 0, "system", "be good"))
        for turn in range(1, rng.randint(2, 40)):
            role = "user" if turn % 2 else "assistant"
            out.append((conv, turn, role, " ".join(rng.choice(["w", "</s>", "[INST]", "<|im_end|>", "\n", "ü"]) for _ in range(rng.randint(0, 60)))))
    out += [(100, 1, "user", None), (100, 2, "assistant", None), (100, 3, None, "no role"), (None, 1, "user", "no id"), (None, None, "assistant", "no turn")]
    out += [(101, 1, "assistant", "same"), (101, 1, "assistant", "same"), (102, 1, "assistant", "long " * 900), (103, 1, "a\nrole", "x")]
    return out


def table(spark, data):
    return spark.createDataFrame([(*r, "extra") for r in data], "conv_id long, turn long, role string, text string, window string")


def test_windows(spark):
    budget = 60
    windows = C.format_conversations(table(spark, rows()), budget).collect()
    by = {}
    for w in windows:
        by.setdefault(w.conv_id, []).append(w)
    for conv, ws in by.items():
        ws.sort(key=lambda w: w.window)
        turns = sorted([r for r in rows() if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        said = [(r[2] or "", r[3] or "") for r in turns]
        back = []
        for w in ws:
            parts = C.read_back(w.text)
            assert len(parts) == w.n_context + w.n_new
            assert w.first_turn == len(back)
            new, context = parts[w.n_context :], parts[: w.n_context]
            if said[0][0] == "system" and w.window:
                assert context[0] == said[0]
                context = context[1:]
            assert len(context) <= C.HISTORY and context == back[len(back) - len(context) :]
            targets = [C.unescape(w.text[s.start : s.end]) for s in w.loss_spans]
            assert targets == [t for role, t in new if role == "assistant"]
            back += new
        assert back == said


def chosen(turns, budget, history):
    """The windows of ``(role, tokens)`` turns, from the whole list at once: first turn, repeated turns, new turns, tokens."""
    system = turns[0][1] if turns[0][0] == "system" else 0
    limit = max(budget, system + budget // 2)
    out, i = [], 0
    while i < len(turns):
        head = system if i else 0
        room = min(budget // 4, limit - head - turns[i][1])
        fits = [k for k in range(history + 1) if i - k >= bool(system) and sum(t for _, t in turns[i - k : i]) <= max(0, room)] if i else [0]
        k = 0
        while k + 1 in fits:
            k += 1
        used = head + sum(t for _, t in turns[i - k : i])
        most = max([n for n in range(1, len(turns) - i + 1) if used + sum(t for _, t in turns[i : i + n]) <= limit], default=1)
        if i + most < len(turns):
            most = max([n for n in range(1, most + 1) if turns[i + n - 1][0] == "assistant"], default=most)
        out.append((i, k + bool(head), most, used + sum(t for _, t in turns[i : i + most])))
        i += most
    return out


def test_which_turns_a_window_takes():
    rng = random.Random(11)
    for _ in range(2000):
        budget, history = rng.choice([20, 60, 100]), rng.randint(0, 3)
        roles = [rng.choice(["user", "assistant"]) for _ in range(rng.randint(1, 25))]
        if rng.random() < 0.5:
            roles[0] = "system"
        turns = [(r, rng.choice([1, 5, 10, 10, 30, 50, 95, 150])) for r in roles]
        made, w = [], C.Windows(budget, history)
        for role, n in turns:
            made += w.push((role, "x", n))
        made += w.flush()
        assert [m[:4] for m in made] == chosen(turns, budget, history)
        system = turns[0][1] if roles[0] == "system" else 0
        limit = max(budget, system + budget // 2)
        for first, n_context, n_new, tokens, *_ in made:
            assert tokens <= limit or (n_new == 1 and n_context <= 1 and turns[first][1] + (system if first else 0) > limit)
            assert not system or not first or n_context >= 1  # a system turn of any length stands in every window


def test_a_very_long_turn_and_a_long_conversation(spark):
    long = "word </s> " * 600_000
    data = [(1, 0, "user", long), (1, 1, "assistant", long), *((2, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(5000))]
    got = {r.conv_id: r for r in C.digest_windows(C.format_conversations(table(spark, data), 50)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].n_windows) == (2, len(long), 2)
    assert got[2].n_turns == 5000 and got[2].loss_chars == sum(len(f"turn {i}") for i in range(0, 5000, 2))


def test_digests(spark):
    got = {r.conv_id: r for r in C.digest_windows(C.format_conversations(table(spark, rows()), 80)).collect()}
    for conv in {r[0] for r in rows()}:
        turns = sorted([r for r in rows() if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars > 0


def test_empty_table(spark):
    assert C.digest_windows(C.format_conversations(table(spark, []))).count() == 0
