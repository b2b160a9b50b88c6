import pytest

from millrace.llm import residue as R
from tests.llm.test_prefilter import examples

GENUINE = "The file covers the region and holds 503 records. Missing cells mostly mean that the value was not measured."


@pytest.mark.parametrize("text", ["Dear {{first_name}}, your data set is ready.", "Result for ${region.name}: it rose by ${change} percent.", "<%= title %> holds rows.", "The table <TABLE_NAME> has <N_ROWS> rows.", "Summary of %DATASET_NAME% for %REGION%.",
                                  "Hello [YOUR NAME HERE], see below.", "Domain: __DOMAIN__ / Author: __AUTHOR__", "#{dataset} was loaded.", "In [[column]] the value is [[value]].", "Title: TBD. Source: XXXX.", "The mean of {column} in {region} is high.", "Each :PLACE: has :AMOUNT: rows.",
                                  "The skill «skill name» is described in «link to page».", "The join of (your metric here) is kept.", "Until <?region?> it was small.", "Compare <<AMOUNT>> with the sum."])
def test_placeholders(text):
    assert R.evidence(text) == "placeholder"
    assert R.evidence(GENUINE + "\n\n" + text + "\n\n" + GENUINE) == "placeholder"


@pytest.mark.parametrize("text", ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "text text text text text text text", "Your description goes here.", "Insert body copy in this box.", "Fugi ossum fugi rebit molor dasit carpa rebit.", "foo bar foo bar foo bar foo bar foo bar"])
def test_filler(text):
    assert R.evidence(text) == "filler"


@pytest.mark.parametrize("text", ["404 - the page you were looking for is not here", "Error 503 Service not available, maintenance in progress", "Access denied. You do not have the rights to open this data set.", "Página no encontrada. Vuelve al inicio.", "<h1>TOO MANY REQUESTS FROM YOUR ADDRESS, SLOW DOWN. (REF A-12)</h1>",
                                  "Erreur interne du serveur, réessayez plus tard.", "Diese Seite gibt es nicht mehr.", "Something went wrong on our side. Try again in a few minutes."])
def test_errors(text):
    assert R.evidence(text) == "error"


@pytest.mark.parametrize("text", ["You need to switch on JavaScript\nto see this app.", "Your browser does not run scripts, so the content is hidden.", "Checking your browser before you continue...", "Bitte schalte JavaScript ein, um die Inhalte zu sehen.", "Para ver esta página activa JavaScript en tu navegador.", "Please accept cookies and enable scripts."])
def test_notices(text):
    assert R.evidence(text) == "script_notice"


@pytest.mark.parametrize("text", [None, "", "  ", GENUINE, "```\n{{ name }}, you have {{ n }} rows\n```", "The engine prints `{{ x }}` when it is not passed.", "My scraper gets a 404 for 279 of the pages, so I store it as missing.", "```\nassert page.status != 404\n```",
                                  "The page of x.csv needs JavaScript, therefore I load it in a headless browser.", "To test the tokenizer we wrote lorem ipsum into the column.", "df = {'a_rate': [465, 38.1], 'b': [x]}", "Rows with TODO in `x` are notes, and I drop these rows.", "The unit was 0.521. The join keeps 404. rows", "See [the guide](http://x) and [1]."])
def test_no_cases(text):
    assert R.evidence(text) is None


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, kind string")


def test_table_and_exclusion(spark):
    rows = [(1, GENUINE, "a"), (2, "404 - page not found", None), (2, "404 - page not found", None), (3, None, "a"), (None, "Lorem ipsum dolor sit amet", "b"), (4, GENUINE * 2000 + "\n\nBad gateway.", "a")]
    df = docs(spark, rows)
    assert sorted(map(tuple, R.find_residue(df).collect()), key=repr) == sorted([(2, "error"), (2, "error"), (4, "error"), (None, "filler")], key=repr)
    assert {r["doc_id"] for r in R.exclude_residue(df).collect()} == {1, 3, None}
    assert R.find_residue(df.limit(0)).count() == 0


def test_recurrent_evidence_stays_evidence(spark):
    rows = [(k, f"Number {k} of the list\n\nFooter of the site\n\n404 - page not found", "host") for k in range(60)]
    df = docs(spark, rows)
    lines = R.recurrent_lines(df, "source", "text", 0.01, 20).first()["boilerplate"]
    assert set(lines) == {R.line_key(x) for x in ("number 0 of the list", "footer of the site", "0 - page not found")}
    assert R.find_residue(df).count() == 60


@pytest.mark.parametrize("text", ["This site is currently unavailable.", "This site is temporarily offline.", "The server is overloaded.", "The server encountered a problem.", "We are offline for the moment.", "The post might have been deleted."])
def test_errors_without_a_cue(text):
    assert R.evidence(text) == "error"


@pytest.mark.parametrize("text", ["Checking your connection.", "DDoS protection by the provider."])
def test_notices_without_a_cue(text):
    assert R.evidence(text) == "script_notice"


@pytest.mark.parametrize("text", ["Blah blah blah.", "foo bar baz", "Paste your text in this box.", "Consectetur adipiscing elit sed eiusmod."])
def test_filler_without_a_cue(text):
    assert R.evidence(text) == "filler"


def test_prefilter_passes_whatever_a_pattern_matches():
    """Texts made from each pattern, all of whose alternatives are taken, are passed on to it."""
    for found in (R._PLACEHOLDERS, R._PAIRED, R._UNFILLED, R._TELLING):
        for p in found.patterns:
            made = examples(p)
            assert made
            for text in made:
                assert p in found.may_match(text.lower(), R._repeats(text.lower())), (p.pattern, text)


def test_long_recurrent_lines_are_subtracted_whole(spark):
    """A recurrent line above 400 characters is boilerplate as a whole, and a line that only begins like it is not."""
    footer = "We cannot find " + "a way to say how the records of this list were once put together by the people " * 6
    assert len(footer) > 400
    df = docs(spark, [(k, f"Some words {k}\n{footer}", "host") for k in range(60)])
    lines = frozenset(R.recurrent_lines(df, "source", "text", 0.01, 20).first()["boilerplate"])
    assert R.line_key(footer) in lines and R.line_key(footer[:400]) not in lines
    split = f"In this app you need to enable\n{footer}\nscripts"
    assert R.evidence(split.replace(footer + "\n", "")) == "script_notice"
    assert R.evidence(split) is None and R.evidence(split, lines) == "script_notice"


def test_recurrent_evidence_beside_content_is_taken_off(spark):
    """A notice in the frame of every page of a host is boilerplate; a page of nothing else is a failed one."""
    notice = "Please enable JavaScript to view comment 4."
    full = [(k, f"The {'abcdefghij'[k % 10] * (k // 10 + 1)} file holds the prices of one region\n\n{notice}", "host") for k in range(60)]
    df = docs(spark, [*full, (100, notice, "host"), (101, notice, "other"), (102, f"Some genuine words about one more file\n\n{notice}", "other")])
    assert {r["doc_id"] for r in R.find_residue(df).collect()} == {100, 101, 102}


@pytest.mark.parametrize("form", [":PLACE:", "[Customer Name]", "%title%", "$amount$", "==name==", "{0}", "{column}", "~~name~~"])
def test_paired_placeholders_far_apart(form):
    far = f"It is {form} here " + "and some more words follow " * 40 + f"until {form} comes again"
    assert R.evidence(far) == "placeholder"
    assert R.evidence(far[:100]) is None


@pytest.mark.parametrize("text", ["Dear {name}, your order is ready.", "Hello [Customer Name]!", "Title: %title%", "{summary}", "Author: [Author Name]"])
def test_single_placeholders_in_a_field(text):
    assert R.evidence(text) == "placeholder"


@pytest.mark.parametrize("text", ["[Solved]", "The set {x} is closed.", "Sort by [Order Date] first.", "It rose by 5% and fell by 3% later."])
def test_single_forms_in_prose_are_none(text):
    assert R.evidence(text) is None
