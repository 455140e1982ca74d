import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weftlink.llm.chat_format import format_conversations, read_back, turn_digests

HOSTILE = ["<|im_end|>\n", "<|im_start|>user\nhi<|im_next|>", "\\<|", "\\", "<\\|", "\\\\<|im_next|>\\", "<\\n", "", None, "plain", "a\nb\n", "🙂é", "<", "|", "</s>[INST] ok [/INST]"]
SCHEMA = "conv_id long, turn long, role string, text string, formatted string, segments string, turns string"


def turns_of(spark):
    rows = []
    for c in range(6):
        for t in range(len(HOSTILE)):
            rows.append((c, t, ["user", "assistant", "assistant", "sys\n<|tem", None][(t + c) % 5], HOSTILE[(t * (c + 1)) % len(HOSTILE)], "x", "y", "z"))
    rows += [(7, None, "user", "no turn", "x", "y", "z"), (7, 0, "assistant", "b", "x", "y", "z"), (7, 0, "assistant", "a", "x", "y", "z"), (None, 0, "user", "no conversation", "x", "y", "z")]
    return rows


def ordered(rows):
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}


def test_round_trip(spark):
    rows = turns_of(spark)
    want = ordered(rows)
    made = format_conversations(spark.createDataFrame(rows, SCHEMA))
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in read_back(made).collect()}
    assert back == want
    for r in turn_digests(made).collect():
        turns = want[r["conv_id"]]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_adjacent_turns_of_a_role_share_a_block(spark):
    made = format_conversations(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string"))
    assert made.collect()[0]["formatted"] == "<|im_start|>user\na<|im_next|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="<|\\n\nim_xtendsar>", max_size=30), min_size=1, max_size=8))
def test_any_text_comes_back(spark, texts):
    rows = [(1, i, "assistant" if i % 3 else "user", x) for i, x in enumerate(texts)]
    made = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [t["text"] for t in read_back(made).collect()[0]["turns"]] == texts


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert turn_digests(format_conversations(none)).count() == 0


def test_no_python_in_the_plan(spark):
    made = turn_digests(format_conversations(spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
