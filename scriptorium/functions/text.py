"""Text functions on columns: trimming, hashing, cleaning, labels. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What trimming removes (the control characters and the blank).
TRIMMED = "".join(map(chr, range(1, 33)))
#: Fixed value: white space of patterns, the ASCII kind only.
SPACE = r"[ \t\n\x0B\f\r]"
#: Fixed value: white space by the Unicode standard without the no-break kinds, for the test of blankness.
BLANK = r"^[\t-\r\x1c-\x1f \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]*$"
#: Words that are no keywords.
STOP_WORDS = (
    "what", "is", "the", "a", "an", "and", "or", "how", "to", "in", "on", "for",
    "with", "about", "tell", "me", "give", "can", "you", "does", "do", "explain",
)
#: Small talk, without its punctuation.
GREETINGS = ("hi", "hello", "hey", "hola", "namaste", "greetings", "good morning", "good evening", "good afternoon")
PLEASANTRIES = ("thanks", "thank you", "thx", "appreciate it", "great", "ok", "okay", "cool", "bye", "goodbye")
ABOUT_ME = ("who are you", "what can you do", "help")
#: The replies to small talk.
REPLIES = {
    "greeting": "Hello! I am your RAG Assistant. Ask me any question about your documents, guides, or data, and I will provide you with a direct, accurate answer.",
    "about": "I am an enterprise RAG assistant. I search across your indexed documents and provide verified, context-grounded answers without unnecessary filler. How can I help you today?",
    "how": "I'm running smoothly and ready to help! What question can I answer for you from your documents?",
    "thanks": "You're welcome! Feel free to ask if you have any other questions.",
    "other": "Hello! How can I assist you with your documents today?",
}
#: Lines that carry a document's metadata begin so.
METADATA_LINES = ("# Document:", "> Source:", "> Total Pages:", "---")
#: The outline and header patterns that are removed, in order.
OUTLINE_PATTERNS = (
    r"(?i)^#\s*Document:.*\r?\n",
    r"(?i)^>\s*Source:.*\r?\n",
    r"(?i)^>\s*Total Pages:.*\r?\n",
    r"(?i)^##\s*Page\s*\d+.*\r?\n?",
    r"(?i)###?\s*INDEX.*\r?\n?",
    r"(?i)S\s+No\.?\s+Chapter\s+Title\s+Page.*\r?\n?",
    r"(?i)Chapter\s+Title\s+Page\s+No\.?",
    r"(?m)^\s*#{1,6}\s*",
    r"(?m)^\s*\d+(\.\d+)*[:.)-]\s*",
    r"(?m)^\s*\(\s*[a-zA-Z0-9]+\s*\)\s*",
    r"(?m)^\s*[a-zA-Z0-9]+\)\s*",
    r"(?i)Tool\s*/\s*Library\s+Primary\s+Purpose\s+&\s+Command",
    r"(?i)Method\s*/\s*Tool\s+Execution\s+&\s+Action",
    r"(?i)Primary\s+Purpose\s+&\s+Command",
    r"(?i)Execution\s+&\s+Action",
    r"(?m)^\s*\|.*\|\s*$",
    r"(?m)^\s*-+\s*DRAFT.*-+\s*$",
    r"(?m)^\s*-{3,}\s*$",
    r"(?m)^\s*(npm\s+x\s+knip|npm\s+audit\s+fix|snyk\s+test|\"no-unused-vars\":\s*\"error\")\s*$",
    r"#\s*\d+(\.\d+)*",
)


def text_of(c: Column) -> Column:
    """A text with null read as empty, as missing fields are."""
    return F.coalesce(c, F.lit(""))


def trim(c: Column) -> Column:
    """Without control characters and blanks at both ends; null stays null."""
    return F.btrim(c, F.lit(TRIMMED))


def is_blank(c: Column) -> Column:
    """Whether a text is null, empty or white space only."""
    return text_of(c).rlike(BLANK)


def content_hash(c: Column) -> Column:
    """`chk_` and 16 hexadecimal digits of the SHA-256 of the trimmed, lower-case text with single spaces.

    Null and blank texts give `chk_empty`.
    """
    normal = F.regexp_replace(F.lower(trim(c)), f"{SPACE}+", " ")
    return F.when(is_blank(c), F.lit("chk_empty")).otherwise(F.concat(F.lit("chk_"), F.substring(F.sha2(normal, 256), 1, 16)))


def cache_key(query: Column, k: Column | int, prefix: str = "rag:answer:") -> Column:
    """The key an answer is cached under: prefix and 16 hexadecimal digits of the SHA-256 of `query:k`."""
    k = k if isinstance(k, Column) else F.lit(k)
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lower(trim(text_of(query))), F.lit(":"), k.cast("string")), 256), 1, 16))


def file_checksum(content: Column) -> Column:
    """SHA-256 of a file's bytes in hexadecimal digits."""
    return F.sha2(content, 256)


def base_name(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def keywords(query: Column, distinct: bool = False) -> Column:
    """Words of more than two letters or digits (ASCII) that are no stop words; with repetitions unless `distinct`."""
    words = F.filter(F.split(F.lower(text_of(query)), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return F.array_distinct(words) if distinct else words


def normalise_query(query: Column) -> Column:
    """Trimmed, with single spaces."""
    return F.regexp_replace(trim(text_of(query)), f"{SPACE}+", " ")


def clamp_top_k(k: Column) -> Column:
    """top_k between 1 and 20; null counts as 5."""
    return F.greatest(F.lit(1), F.least(F.lit(20), F.coalesce(k, F.lit(5))))


def small_talk_form(query: Column) -> Column:
    """Lower-case letters and single spaces only."""
    return F.regexp_replace(F.regexp_replace(F.lower(trim(text_of(query))), r"[^a-z \t\n\x0B\f\r]", ""), f"{SPACE}+", " ")


def small_talk_reply(query: Column) -> Column:
    """The reply to a greeting, a question about the assistant, or thanks."""
    form = small_talk_form(query)
    return (
        F.when(form.isin(*GREETINGS), REPLIES["greeting"])
        .when(form.isin(*ABOUT_ME), REPLIES["about"])
        .when(form == "how are you", REPLIES["how"])
        .when(form.isin(*PLEASANTRIES), REPLIES["thanks"])
        .otherwise(REPLIES["other"])
    )


def lines_of(c: Column) -> Column:
    """The lines of a text, as a reader gives them: no empty last line after a line end."""
    return F.split(F.regexp_replace(text_of(c), r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")


def clean_content(c: Column) -> Column:
    """Without lines of document metadata and page marks; trimmed. Null gives ''."""

    def keep(line: Column) -> Column:
        bare, out = trim(line), F.lit(False)
        for mark in METADATA_LINES:
            out = out | bare.startswith(mark)
        low = F.lower(bare)
        return ~(out | low.startswith("## page ") | low.startswith("page "))

    return trim(F.array_join(F.filter(F.split(text_of(c), r"\r?\n"), keep), "\n"))


def strip_outline(c: Column) -> Column:
    """Without headers, outline numbers, index lines and table borders; blank gives ''."""
    out = text_of(c)
    for pattern in OUTLINE_PATTERNS:
        out = F.regexp_replace(out, pattern, "")
    return F.when(is_blank(c), F.lit("")).otherwise(trim(out))


def sources_list(sources: Column, document: Column, page: Column) -> Column:
    """A `; `-joined list of sources as an array; blank gives the row's own `document:pN`."""
    parts = F.filter(F.split(sources, r";\s*"), lambda x: trim(x) != "")
    return F.when(is_blank(sources), F.array(source_label(document, page))).otherwise(parts)


def source_label(document: Column, page: Column) -> Column:
    """`document:pN`."""
    return F.concat(text_of(document), F.lit(":p"), F.coalesce(page, F.lit(0)).cast("string"))


def citation_label(document: Column, sources: Column) -> Column:
    """The document, and the list of its sources when there are several."""
    return F.when(
        F.size(sources) > 1, F.concat(document, F.lit(" (also in: "), F.array_join(sources, ", "), F.lit(")"))
    ).otherwise(document)


def preview(c: Column, length: int = 250, collapse: bool = True) -> Column:
    """The beginning of a text, with `...` where it is cut."""
    flat = trim(F.regexp_replace(text_of(c), f"{SPACE}+", " ")) if collapse else text_of(c)
    return F.when(F.length(flat) > length, F.concat(F.substring(flat, 1, length), F.lit("..."))).otherwise(flat)


def context_line(rank: Column, label: Column, page: Column, heading: Column, text: Column) -> Column:
    """One numbered entry of an answer's context."""
    return F.concat(
        F.lit("["), rank.cast("string"), F.lit("] Document: "), label, F.lit(" | Page: "), page.cast("string"),
        F.lit(" | Section: "), heading, F.lit("\n"), text, F.lit("\n\n"),
    )


def prompt(context: Column, query: Column) -> Column:
    """The prompt of a language model: rules, context, question."""
    return F.concat(
        F.lit("Answer the question from the context alone. If the context has no answer, say so.\n\nCONTEXT:\n"),
        context, F.lit("\nQUESTION:\n"), query, F.lit("\n\nANSWER:\n"),
    )


def client_address(forwarded: Column, real: Column, remote: Column) -> Column:
    """The first forwarded address, else the real one, else the remote one; blanks count as missing."""

    def given(c: Column) -> Column:
        return F.when(~is_blank(c), trim(c))

    return F.coalesce(given(F.element_at(F.split(forwarded, ","), 1)), given(real), remote)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """part / whole in percent, rounded half up; 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part * 100.0 / whole, digits))
