"""Text-quality predicates on columns. Null texts count as empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import text as T

#: Marks of program code; two of them make a text a code dump.
CODE_MARKS = (
    "def ", "return ", "import ", "try:", "except ", "print(", "class ", "os.path", "with open", "while ", "writer.",
    "reader.", "uuid.", "len(", "range(", ".append(", "elif ", "else:", "==", "!=", "lambda ", "self.", "status_log",
    "chunk_path",
)
#: Words by which a query asks for code or for a curriculum vitae.
ASKS_FOR_CODE = ("code", "script", "python", "function", "implement", "program")
ASKS_FOR_RESUME = ("resume", "candidate", "experience", "intern", "profile", "developer", "cv", "education", "skills")
#: Marks of index pages, of notices, of a staged preamble.
INDEX_MARKS = ("s no. chapter title page", "chapter title page no", "### index")
NOTICE_MARKS = ("public service commission", "assistant professor")
PREAMBLE = r"(?is)^#\s*Document:.*>\s*Source:.*>\s*Total Pages:.*$"


def any_of(c: Column, marks: tuple[str, ...]) -> Column:
    """Whether a text contains any of the marks."""
    return reduce(lambda a, b: a | b, (c.contains(m) for m in marks))


def is_conversational(query: Column) -> Column:
    """A greeting, thanks, or a question about the assistant; blank is none."""
    form = T.small_talk_form(query)
    return ~T.is_blank(query) & form.isin(*T.GREETINGS, *T.PLEASANTRIES, *T.ABOUT_ME, "how are you")


def is_boilerplate(text: Column) -> Column:
    """Blank, or the preamble of a staged document."""
    bare = T.trim(T.text_of(text))
    short = (F.length(bare) < 240) & (bare.startswith("# Document:") | bare.startswith("> Source:"))
    return T.is_blank(text) | short | bare.rlike(PREAMBLE)


def is_cover_page(text: Column) -> Column:
    """Blank, a preamble, a short notice, or an index."""
    low, size = F.lower(T.text_of(text)), F.length(T.text_of(text))
    return (
        T.is_blank(text)
        | (low.startswith("# document:") & (size < 280))
        | (any_of(low, NOTICE_MARKS) & (size < 220))
        | any_of(low, INDEX_MARKS)
    )


def is_resume(document: Column, text: Column, query: Column, names: tuple[str, ...] = ()) -> Column:
    """A curriculum vitae, unless the query asks for one. `names`: further document names that are one."""
    wanted = any_of(F.lower(T.text_of(query)), ASKS_FOR_RESUME + names)
    doc, low = F.lower(T.text_of(document)), F.lower(T.text_of(text))
    # fixed values: marks of a curriculum vitae, in its name and in its text
    by_name = any_of(doc, ("resume", "cv") + names)
    by_text = (
        any_of(low, ("b.tech", "curriculum vitae", "full-stack web development intern"))
        | (low.contains("education") & low.contains("cgpa"))
        | (low.contains("technical skills") & any_of(low, ("github", "linkedin")))
    )
    return ~wanted & (by_name | (~T.is_blank(text) & by_text))


def is_code_dump(text: Column, query: Column) -> Column:
    """A text with at least two marks of program code, unless the query asks for code."""
    low = F.lower(T.text_of(text))
    hits = reduce(lambda a, b: a + b, (low.contains(m).cast("int") for m in CODE_MARKS))
    return ~any_of(F.lower(T.text_of(query)), ASKS_FOR_CODE) & (hits >= 2)


def is_usable_vector(id_: Column, text: Column, embedding: Column) -> Column:
    """A stored vector that the registry takes: an embedding, a key and a text."""
    return embedding.isNotNull() & ~T.is_blank(id_) & ~T.is_blank(text)
