from __future__ import annotations

import pytest

from scriptorium.llm import residue as R

PROSE = "The works council must review the draft bank guarantee and report the result within 31 days to the receiving depot."


@pytest.mark.parametrize(
    "slot",
    ["{{employee_name}}", "{{ order.date }}", "${amount}", "#{unit}", "{!city}", "{0}", "<%= po %>", "<<unit>>", "«vendor»", "%%CITY%%", "%(site)s",
     "__AMOUNT__", "@@OFFICER@@", "[[party_b]]", "[Insert clause here]", "<NAME OF CONTRACTOR>", "[DD/MM/YYYY]", "XX/XX/XXXX", "XXXXXX", "[object Object]",
     "undefined", "{% if unit %}", "[ADDRESS LINE 1]"],
)
def test_slots(slot):
    assert R.has_slot(f"{PROSE} The sum of {slot} was filed.")


@pytest.mark.parametrize(
    "text",
    ["In the letter template the token {{employee_name}} stands for the name of the employee.", "The import job replaces ${amount} by the figure in column 7.",
     "Fields in square brackets, such as [insert date], tell the drafter where a value belongs.", "The set {a, b} and the range <5 to 58> are listed in Rule 3 [3].",
     "Samples marked XX are test pieces; text goes here and there.", "[93]"],
)
def test_explanations_are_no_slots(text):
    assert not R.has_slot(text)


MESSAGES = [
    "404 Not Found", "HTTP 500 – Internal Server Error", "### 1.2 Audit\nError 1020: request blocked by the gateway\nRequest 0a707ac4ae82 at X-2",
    "Please enable JavaScript to view this page.", "Veuillez activer JavaScript pour afficher ce document.", "Bitte aktivieren Sie JavaScript, um den Inhalt zu sehen.",
    "Seite nicht gefunden (404)", "Página no encontrada", "Your text goes here (block 9)", "test test test 7", "xxxx xx xxx xxxx.", "Text follows.",
    "Home\nMaps\nPress 12\nAccess denied. You do not have permission to view this page.\nForms · Wiki · Budget 4",
    "Lorem ipsum dolor sit amet consectetur adipiscing elit.", PROSE + " Lorem ipsum dolor sit amet consectetur. Magna minim do incididunt lorem.",
]
CONTENT = [
    PROSE, "If the portal answers with 404 Not Found, check the form number 3 and call the help desk.", "Before the roster is opened on the kiosk, enable JavaScript in the browser.",
    "The style guide calls the dummy passage lorem ipsum and asks authors to remove it.", "Reading 500 on the panel is an internal server error of unit 7.", None, "", " \n",
    "Home\nMaps\nPress 12", PROSE + "\n404 Not Found",
]


def test_records(spark):
    rows = [("t", i, x, "clash") for i, x in enumerate(MESSAGES + CONTENT)] + [("t", 1000 + i, MESSAGES[0], "clash") for i in range(1200)]
    frame = spark.createDataFrame(rows, "src_table string, row_id long, text string, kind string")
    found = {r["row_id"] for r in R.find_residue(frame).collect()}
    assert found == {*range(len(MESSAGES)), *range(1000, 2200)}
    assert R.keep_content(frame).count() == len(CONTENT)
    assert R.find_residue(frame.limit(0)).count() == 0


def test_tree_merges_and_keeps_apart():
    tree = R.MessageTree()
    assert tree.add("page a b c d missing") == tree.add("page a b x d missing")
    assert tree.leaves[R.leaf_of("page a b c d missing")] == [["page", "a", "b", "*", "d", "missing"]]
    assert tree.add("site a b c d missing") != tree.add("page a b c d missing")
    assert tree.add("page a b") != tree.add("page a b c d missing")
    assert R.leaf_of("page 7 b c") == R.leaf_of("page 8 b c")


PAGE = (
    "404 Not Found\nThe page you requested could not be located on this server. It may have been moved or deleted. Check the address and try again.\n"
    "If the problem persists, tell us what you did. You may return to the home page or contact the administrator. Our team has been notified of the error."
)
TRACE = "Traceback (most recent call last):\n" + "\n".join(f'File "/srv/app/step{i}.py", line {i}, in run' for i in range(12)) + "\nValueError: bad value"


@pytest.mark.parametrize(
    "text",
    [f"{PROSE} Text follows. {PROSE}", f"{PROSE}\nAdd body text here.\n{PROSE}", f"{PROSE} Blindtext. {PROSE}", f"{PROSE} This is placeholder copy. {PROSE}",
     f"{PROSE} Ut enim ad minim veniam, quis nostrud exercitation ullamco. {PROSE}", f"{PROSE} Duis aute irure dolor in reprehenderit in voluptate. {PROSE}"],
)
def test_filler_between_ordinary_sentences(text):
    assert R.has_filler(text)


def test_ordinary_sentences_are_no_filler():
    for text in ("The goods are to be supplied.", "Enter the description.", "Sample copy of the invoice is filed.", "Qui est in culpa non est.", "The text follows the form."):
        assert not R.has_filler(f"{PROSE} {text} {PROSE}"), text


SERVER = (
    "Internal Server Error\nThe server encountered an internal error or misconfiguration and was unable to complete your request. Please contact the server administrator at "
    "webmaster@example.org to inform them of the time this error occurred, and the actions you performed just before this error. More information about this error "
    "may be available in the server error log. Additionally, a 500 error was encountered while trying to use an ErrorDocument."
)
TABLE = "| Item | Place | Qty | Rate |\n|---|---|---|---|\n| lift gate | Yarnova | 404 | USD 2 |\n| dust filter | Galvik | 500 | USD 7 |\n| spindle | Lundale | 503 | USD 1 |"


def _found(spark, texts):
    rows = [("t", i, x) for i, x in enumerate(texts)]
    return {r["row_id"] for r in R.find_residue(spark.createDataFrame(rows, "src_table string, row_id long, text string")).collect()}


def test_long_pages_tables_and_templates(spark):
    texts = [PAGE, TRACE, SERVER, TABLE, f"{PROSE} {PROSE}\n404 Not Found\n{PROSE}", "404 Not Found\n" + TABLE, "500"]
    assert _found(spark, texts) == {0, 1, 2}


def test_verdicts_are_propagated(spark):
    # the form of a seed is hidden in one unit of the template; a companion recurs with messages only
    odd = [f"Error {i}: request to host {w} was blocked by the outer gateway\nQuote the mark {w} to the desk of the house." for i, w in enumerate(("ab", "cd", "ef", "gh"))]
    apart = ["The mark of the house is kept by the desk of the town and shown to all."]
    assert _found(spark, [*odd, *apart, PROSE]) == {0, 1, 2, 3}


def test_slots_beside_other_words():
    assert R.has_slot("The variable speed drive of the second pumping unit was sent by road to {{city}} on Monday.")
    assert R.has_slot(PROSE[:-1] + " and " * 200 + "to {{" + "long_name_" * 9 + "}}.")
    assert not R.has_slot("Here the variable {{city}} names the place.")
    assert not R.has_slot("[[" + PROSE + " " + PROSE + "]]")
