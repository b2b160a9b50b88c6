import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pairs as P

Q = "How can I compute the median of every group without losing the rows where the value is missing? My script uses groupby and then joins the second file on the key."
T = "How to keep rows with missing values in a group median"
ES = "¿Cómo puedo calcular la mediana de cada grupo sin perder las filas donde falta el valor? Mi código usa una unión y luego devuelve menos filas."
GOOD = "Fill the gaps first and group afterwards. The extra rows come from the join, because the second file lists some keys more than once."


@pytest.mark.parametrize("a", [None, "", "  \n\t", "​", "...", "?", "<p></p>", "<div> </div>", "&nbsp;", "```python\n\n```", "N/A", "none", "[no answer]", "(empty)", "---", "***", "null"])
def test_empty(a):
    assert P.defect(a, Q, T) == "empty"


@pytest.mark.parametrize("a", ["No.", "No. `key` must be unique.", "Yes, sort by it first.", "42", "df.dropna()", "Use `melt`."])
def test_short_answers_are_fine(a):
    assert P.defect(a, Q, T) is None


@pytest.mark.parametrize("a", ["I'm sorry, but I can't help with that.", "As a language model, I do not have access to x.csv, so I must decline to answer. Thank you for understanding.", "Lo siento, pero no puedo ayudarte con eso.",
                               "Désolé, je ne peux pas répondre à cette demande.", "Dazu darf ich leider keine Auskunft geben. Danke für dein Verständnis.", "I will not be able to answer this one. Please consult a qualified expert instead."])
def test_refusals(a):
    assert P.defect(a, None, None) == "refusal"


@pytest.mark.parametrize("a", ["Sorry, I can't reproduce it, but `merge` returns 12 with your sample, so check the type of the key.", "You are not allowed to pass x twice to `merge`. Rename it and the error disappears.",
                               "I'm sorry this took so long. I cannot recommend a loop here; call `melt` and the total becomes 12.", "Unfortunately `cut` is unable to read it directly, so convert it first."])
def test_answers_with_refusing_words(a):
    assert P.defect(a, Q, T) is None


def test_copied():
    assert P.defect(Q, Q, T) == "copied"
    assert P.defect("Question: " + Q.upper(), Q, T) == "copied"
    assert P.defect(T, None, T) == "copied"
    assert P.defect("> " + Q, Q, None) == "copied"
    assert P.defect("> " + Q + "\n\n" + GOOD, Q, T) is None


def test_other_language():
    assert P.defect(ES, Q, T) == "other_language"
    assert P.defect(GOOD, ES, None) == "other_language"
    assert P.defect(GOOD, "  ", "¿Cómo calcular la mediana de cada grupo sin perder las filas?") == "other_language"
    assert P.defect(GOOD, None, None) is None
    assert P.defect("```python\nthe of and is = 1\n```", ES, None) is None


@pytest.mark.parametrize("end", ["The extra rows come from", "Then apply it (", "And drop the …", "Use this:", "\n\n```python\ndf = x.mer"])
def test_truncated(end):
    assert P.defect(GOOD + " " + end, Q, T) == "truncated"


@pytest.mark.parametrize("end", ["\n\nHope this helps", "\n\nCheers", "\n\nThat is all :)", "\n\n```python\ndf = x.merge(y)\n```", "\n\n| a | b |\n|---|---|\n| 1 | 2 |"])
def test_complete_without_a_full_stop(end):
    assert P.defect(GOOD + end, Q, T) is None


def test_list_items_need_no_stop():
    assert P.defect("- Fill the gaps of the column first\n- Group the rows by the key afterwards\n- Compare both totals at the end", Q, T) is None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_automaton_finds_the_longest_run(prompt, response):
    got = P.SuffixAutomaton(prompt).matches(response)
    runs = {tuple(prompt[i:j]) for i in range(len(prompt)) for j in range(i, len(prompt) + 1)}
    want = [max(n for n in range(k + 2) if tuple(response[k + 1 - n : k + 1]) in runs | {()}) for k in range(len(response))]
    assert got == want


def test_table(spark):
    rows = [("a", None, Q, T, 1), ("a", None, Q, T, 2), (None, "", None, None, 3), ("b", GOOD, Q, T, 4), ("c", "x " * 60_000 + "end.", Q, T, 5)]
    df = spark.createDataFrame(rows, "example_id string, answer string, question string, title string, defect int")
    assert sorted(map(tuple, P.find_defects(df).collect()), key=repr) == [("a", "empty"), (None, "empty")]
    assert P.find_defects(df.limit(0)).count() == 0


@pytest.mark.parametrize("a", ["Sorry, this is outside my capabilities.", "That would violate my principles.", "This goes against our rules.", "This question may not be answered.", "No answer may be given here.", "No estoy autorizada a responder.", "No tengo acceso a esa información.", "Eso va en contra de mis normas."])
def test_refusals_without_a_cue(a):
    assert P.defect(a, None, None) == "refusal"


def test_long_refusals():
    long = "I'm sorry, but I can't help with that. " * 60 + "Thank you for understanding."
    assert len(long) > 2000 and P.defect(long, None, None) == "refusal"
    assert P.defect(long + " Fill the gaps first and group afterwards.", None, None) is None
