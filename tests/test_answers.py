"""The retry ladder, and the processing of replies."""

from pyspark.sql import functions as F

from dossier_spark.operators import answers as A


def test_ladder(spark):
    def model(prompt):
        if prompt.startswith("slow"):
            raise TimeoutError
        if prompt.startswith("broken"):
            raise OSError
        if prompt.startswith("json") and "plain text" not in prompt:
            return '{"a": 1}'
        if prompt.startswith("bad"):
            return "XX" if prompt.startswith("bad for ever") or "Check before" not in prompt else "good"
        return prompt.split()[0]

    rows = [(1, "slow one", "short one"), (2, "slow two", None), (3, "slow three", "slow again"), (4, "broken", "x"), (5, "json", None), (6, "bad", None), (7, "bad for ever", None), (8, "fine", None)]
    df = spark.createDataFrame(rows, "id int, prompt string, retry_prompt string")
    got = {r.id: (r.answer, r.attempts, r.failure) for r in A.generate(df, model).collect()}
    assert got == {1: ("short", 2, None), 2: ("", 1, "LLM_TIMEOUT"), 3: ("", 2, "LLM_TIMEOUT"), 4: ("", 1, "LLM_ERROR"), 5: ("json", 2, None), 6: ("good", 2, None), 7: ("XX", 2, None), 8: ("fine", 1, None)}


def test_processed(spark):
    rows = [
        (1, "short", "```\nok\n```", None, 1, True, 2, None, None), (2, "short", "x", None, 0, True, 2, None, None), (3, "short", None, None, 1, False, 2, None, "LLM_TIMEOUT"), (4, "short", "source 1", None, 1, False, 2, None, None),
        (5, "constrained", "OUI", None, 1, False, 2, ["Oui", "Non"], None), (6, "constrained", "peut-être", None, 1, False, 2, ["Oui", "Non"], None), (7, "constrained", "", None, 1, False, 2, ["Oui"], None), (8, "deterministic", None, " Lausanne ", 0, True, 2, None, None),
        (9, "deterministic", "x", None, 0, True, 2, None, None), (10, "short", "json: __VIDE__", None, 1, False, 2, None, None), (11, "constrained", "{{x}}", None, 1, False, 2, ["Oui"], None),
    ]
    df = spark.createDataFrame(rows, "id int, kind string, answer string, deterministic string, n_passages int, require_sources boolean, max_lines int, allowed array<string>, failure string")
    got = {r.id: (r.value, list(r.missing_info)) for r in A.processed(df).collect()}
    assert got == {
        1: ("ok", []), 2: ("", ["NO_CONTEXT"]), 3: ("", ["LLM_TIMEOUT"]), 4: ("", ["FORBIDDEN_OUTPUT"]), 5: ("Oui", []), 6: ("", ["NON_AUTORISE"]), 7: ("", ["NON_AUTORISE"]), 8: ("Lausanne", []),
        9: ("", ["DETERMINISTIC_EMPTY"]), 10: ("", ["EMPTY"]), 11: ("", ["FORBIDDEN_OUTPUT", "NON_AUTORISE"]),
    }


def test_summary_prompts(spark):
    """A document longer than the budget in pieces that make it up; summaries packed in order, the last prompt with the person."""
    df = spark.createDataFrame([("c", f"d/p{i:03}", f"t{i}" * (1 if i else 700)) for i in range(7)], "client_id string, path string, text string")
    got = A.summary_prompts(df, 1000).orderBy("path", "piece").collect()
    assert max(len(r.prompt) for r in got) <= 1000 and {r.name for r in got} == {f"p{i:03}" for i in range(7)}
    body = [r.prompt.split("CONTENU DU DOCUMENT :\n")[1] for r in got]
    assert "".join(b for r, b in zip(got, body, strict=True) if r.path == "d/p000") == "t0" * 700 and body[-1] == "t6"
    s = spark.createDataFrame([("c", f"p{i:03}", 0, f"p{i:03}", "x" * 90) for i in range(30)] + [("e", "a", 0, "a", "one"), ("e", "b", 0, "b", "two")], "client_id string, path string, piece int, name string, reply string")
    merged = A.merge_prompts(s, F.lit("Jo"), 1800, 100).orderBy("client_id", "piece").collect()
    assert all(len(r.prompt) <= 1800 for r in merged) and [r.final for r in merged] == [False] * (len(merged) - 1) + [True] and len(merged) > 2
    names = [n.split(" ---")[0] for r in merged if r.client_id == "c" for n in r.prompt.split("--- Résumé de ")[1:]]
    assert names == [f"p{i:03}" for i in range(30)]
    assert merged[-1].prompt.startswith(A.OF_REPORT[0] + "Jo.") and merged[-1].prompt.endswith("--- Résumé de a ---\none\n\n--- Résumé de b ---\ntwo\n\n")
