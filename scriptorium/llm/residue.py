"""Problem 2: template slots left unfilled, filler text, error pages and scripts-required notices.

Records are cut into units, their sentences and the parts of their lines. A prefix tree of fixed depth
(number of words, then the first words, numbers masked) mines templates of the units; a template is
classified once, by what it covers, and its verdict goes back to all records with a unit of it:

- it is a message if most of its units have the form of one (the lists below are seeds only; units
  without such a form get the verdict of their template), unless it hardly ever stands without prose;
- it belongs to messages if most of its units have a form that follows messages, or if it recurs and
  practically never occurs without a message in the record.

A record is a case if it holds a message and all but MOST_OTHER of its words belong to messages. Labels
of menus count neither way; rows of tables are prose. No length is set to records, units or windows.
Only leaves that a seed falls into can give messages, so only records with a unit in one are mined.
Unresolved slots and passages of filler are looked for in every record on their own, sentence by
sentence; sentences that explain the slot or mention such things don't count. Brackets around words
are a slot up to 40 characters, as longer ones are remarks; all other slots may have any length within
a sentence.

Null, empty and blank texts are no cases. Extra columns are ignored. A unit that a third of all rows
hold is counted once before it is classified, and its verdict is joined back with hot keys apart.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.frames import likely_rows, map_batches, map_text
from scriptorium.operators.skew import join_groups
from scriptorium.session import write_table

#: Forms of slots in template languages and forms.
_SLOT = re.compile(
    r"\{\{(?:(?![.!?]\s)[^{}\n])+\}\}|\{%[^{}%\n]+%\}|\{![^{}\n]+\}|[$#]\{(?:(?![.!?]\s)[^{}\n])+\}"
    r"|\{[A-Za-z_][\w.]*\}|\{\d{1,2}\}"
    r"|<%[^%\n]+%>|<<(?:(?![.!?]\s)[^<>\n])+>>|«[A-Za-z_][\w.]*»|‹[A-Za-z_][\w.]*›"
    r"|%%[A-Za-z_][\w. ]*%%|%\((?:(?![.!?]\s)[^()\n])+\)[sd]|(?<![A-Za-z0-9_])__[A-Za-z][\w.]*?__(?![A-Za-z0-9_])"
    r"|@@[A-Za-z_][\w.]*@@|\[\[(?:(?![.!?]\s)[^\[\]\n])+\]\]|\[object Object\]|\bundefined\b|\bXX/XX(?:/XX(?:XX)?)?\b|\bX{4,}\b"
    r"|(?:DD|MM|TT|JJ|AAAA|YYYY)[./-](?:DD|MM|TT)[./-](?:YYYY|AAAA|JJJJ)"
    r"|[\[<](?=[^\W\d_])(?:[^\W\d_]|[ /’'-]){3,40}\d{0,2}[\]>]"
)
#: What sentences say that explain or mention slots.
_EXPLAINS = re.compile(
    r"(?i)\b(?:stands? for|placeholders?|is filled|are filled|is replaced|replaces|square brackets|curly brackets|such as"
    r"|token|import job|drafter|print run|mail merge|where a value belongs|the variable|the field|steht für|ersetzt"
    r"|représente|remplace|sustituye|representa)\b"
)
#: Explanations that hold wherever they stand in the sentence; all others have to stand beside the slot.
_ABOUT = re.compile(r"(?i)\b(?:placeholders?|square brackets|curly brackets|mail merge|where a value belongs)\b")
_BESIDE = 5  # words
_FILLER_WORDS = frozenset(
    # The words of the customary filler text.
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et "
    "dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo "
    "consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint "
    "occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_TELLING_FILLER = frozenset(w for w in _FILLER_WORDS if len(w) >= 5)
#: Sentences that are filler also between ordinary ones.
_FILLER_SENTENCE = re.compile(
    r"(?i)^(?:your text (?:goes )?here\b.{0,12}|(?:add|insert|enter|type|place|put|write) (?:\w+ ){0,3}(?:text|content|copy|description) here\b.{0,12}"
    r"|click (?:here )?to (?:edit|add) (?:\w+ ){0,2}(?:text|content|copy|description)|(?:text|content|description|details?) (?:follows|to follow|goes here|coming soon)"
    r"|this is (?:(?:a|an|some|only|just) ){0,2}(?:placeholder|dummy|sample|filler)(?: (?:text|copy|content|paragraph|passage))?"
    r"|(?:sample|dummy|placeholder|filler|example) (?:text|copy|content|paragraph)(?: (?:here|goes here|only|\d+))?|(?:das|dies) ist (?:ein )?(?:blindtext|platzhalter|mustertext|beispieltext)"
    r"|(?:blindtext|platzhalter(?:text)?|mustertext|beispieltext)(?: \d+)?|(?:hier )?(?:folgt|steht) (?:\w+ ){0,3}(?:text|inhalt)|text folgt|(?:texto|contenido) de (?:prueba|relleno|ejemplo)"
    r"|texte? (?:d['’]exemple|factice|provisoire|de remplissage|à venir|à remplacer)|(?:test ){2,}(?:test)?(?: ?\d+)?|x{2,}(?:\W+x{2,})+\W*\d*|replace this (?:text|copy|content)(?: with your own)?)"
    r"[\s.…!)\]]*$"
)
_TRACE = re.compile(r"^Traceback \(most recent call last\)|^Exception in thread\b|^(?:\w+\.)*\w+(?:Error|Exception)(?::|$)")
#: What error pages and notices say after their message, and lines of stack traces.
_FOLLOWS = re.compile(
    r"(?i)^(?:at [\w.$<>]+\(|file \"|caused by:|\.\.\. \d+ more\b)"
    r"|^(?:please |you (?:can|may|could|should) )?(?:check|verify) (?:the|your) (?:address|url|link|spelling|connection|browser)|^(?:please )?(?:try again|try refreshing|refresh|reload|retry)\b"
    r"|^(?:please |you (?:can|may|could|should) )?(?:go back|return|contact)\b.*\b(?:page|home|site|administrator|webmaster|support|help desk|helpdesk)\b"
    r"|^if (?:the|this) (?:problem|error|issue)\b|^(?:it|the (?:page|document|file|resource|link|address|url)(?: you (?:are looking|were looking|requested|asked)(?: for)?)?) (?:may|might|could|was|has|does|is|cannot)\b.*\b(?:moved|deleted|removed|renamed|exist|found|available|mistyped|wrong|expired|outdated|located|loaded|displayed)\b"
    r"|^(?:the|this|your|our) (?:server|request|requested|browser|session|application|site|page|viewer|service|gateway|proxy|url|resource|web server|administrator|team)\b.*\b(?:server|request|requests|error|unable|not|scripts?|javascript|cookies|notified|failed|again|located|temporarily|requires?|misconfiguration|maintenance|capacity|problems?)\b"
    r"|^(?:we|sorry|apologies|unfortunately)\b.*\b(?:page|error|inconvenience|server|request|sorry|apologi[sz]e|problem)\b|^(?:after|once|when|then)\b.*\b(?:enabled?|enabling|javascript|scripts?|reload|refresh)\b"
    r"|^(?:without|some|most|all)\b.*\b(?:javascript|scripts?|cookies)\b|^(?:additionally|more information|error code|error id|status code|request id|reference|incident|trace)\b"
)
#: How messages begin, or lines that are one, by kind.
_MESSAGES = {
    "script": re.compile(
        r"(?i)^(?:please |veuillez |bitte |you need to |you must |por favor,? )?(?:enable|activate|activer|activez|aktivieren|active|activa|habilite|turn on|allow)\b[^.]*\b(?:javascript|scripts?|cookies)"
        r"|^(?:javascript|scripts?|cookies)\b[^.]*\b(?:disabled|required|needed|must be|deaktiviert|désactivé|desactivado|nicht aktiviert|erforderlich|off)\b"
        r"|^(?:your|this|ihr|votre|su) (?:browser|navigateur|navegador)\b[^.]*\b(?:scripts?|javascript|supported|unterstützt)"
        r"|^this (?:viewer|page|site|app|document|content)\b[^.]*\brequires? (?:javascript|scripts?|cookies)"
        r"|^(?:noscript|checking your browser)\b|^loading\b.*\b(?:scripts?|javascript)\b|^turn scripts on"
        r"|^(?:diese|cette|esta|este) \w+ (?:benötigt|erfordert|nécessite|requiere|necesita)\b[^.]*\b(?:javascript|scripts?)"
    ),
    "error": re.compile(
        r"(?i)^(?:http |error |erreur |fehler |status )*(?:4\d\d|5\d\d)\b\s*(?:[–:)-]\s*[^\W\d_]|not found|forbidden|bad|internal|gateway|service|unauthori[sz]ed|error|too many|request|gone|unavailable|time)"
        r"|^(?:http |error |erreur |fehler |status )+(?:4\d\d|5\d\d)$|^(?:error|erreur|fehler|fatal error|warning:|exception|traceback)\b(?: \d+)?\s*(?::|–|-|interno|interne|$|while|\d)"
        r"|^(?:page|seite|página|document|file|datei|archivo|fichier)\b[^.]{0,25}\b(?:not found|nicht gefunden|no encontrad[oa]|introuvable)"
        r"|^the (?:page|document|file|resource|site|preview|content|server)\b[^.]*\b(?:could not|cannot|can't|failed|not be found|no longer available|unavailable|is down)"
        r"|^this (?:page|document|file|content|site|resource)\b[^.]*\b(?:no longer available|not available|unavailable|could not|cannot be|has been removed|has moved)"
        r"|^(?:access denied|zugriff verweigert|accès refusé|acceso denegado|permission denied|forbidden|unauthorized|bad gateway|not found)\b"
        r"|^(?:internal server error|interner serverfehler|service (?:temporarily )?unavailable|gateway time-?out|connection (?:timed out|reset|refused))"
        r"|^(?:an? )?(?:unexpected|unknown|internal|server|database|system) error\b|^something went wrong|^oops\b"
        r"|^(?:cannot|can't|could not|unable to|failed to) (?:display|load|open|render|connect|find|show)\b"
        r"|^too many requests|^your session (?:has )?(?:expired|timed out)|^session expired"
        r"|^(?:site|system|server|service) (?:is )?(?:under|down for) maintenance|^under maintenance|^(?:le |el |der |the )?(?:service|servicio|dienst)\b[^.]*\b(?:indisponible|no disponible|nicht verfügbar|unavailable|not available)"
        r"|^please try again later|^request blocked|^you do not have permission"
    ),
    "filler": re.compile(
        r"(?i)^lorem ipsum|^your text\b|^(?:add|insert|enter|type|place) (?:\w+ ){0,2}(?:text|content|copy|description)\b.{0,12}$"
        r"|^click (?:here )?to (?:edit|add)\b|^(?:text|content|description|details?) (?:follows|to follow|goes here|coming soon)\b"
        r"|^this is (?:a )?(?:placeholder|dummy|sample|filler)\b|^(?:sample|dummy|placeholder|filler|example) (?:text|copy|content|paragraph)\b"
        r"|^blindtext\b|^platzhalter\b|^(?:mustertext|beispieltext)\b|^text folgt\b|^(?:texto|contenido) de (?:prueba|relleno|ejemplo)\b"
        r"|^texte? (?:d['’]exemple|factice|provisoire|de remplissage|à venir|à remplacer)\b|^(?:test ){2,}|^coming soon\b|^(?:tbd|tba|todo|n/a)\W*$"
        r"|^x{2,}(?:\W+x{2,})+\W*\d*\W*$|^(?:asdf|qwerty|foo bar)\b|^hier (?:folgt|steht)\b.*\b(?:text|inhalt)\b|^replace this\b"
    ),
}
_HEADING = re.compile(r"^#{1,6}\s")
_REQUEST = re.compile(r"(?i)^(?:request|ray|trace|incident|reference|error) (?:id:? )?[0-9a-f]{6,}\b")
_SEPARATOR = re.compile(r"\s+[·›»|•>]\s+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_TOKEN = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"\b(?![45]\d\d\b)\d+|(?<=[^\W\d])\d+")  # all but status codes
_TABLE_ROW = re.compile(r"^\|.*\|")
MOST_OTHER = 0.25  # share of words that belong to no message
FEW_OTHER = 4  # words that may belong to no message whatever their share
LABEL = 3  # words of a menu's label at most
DEPTH = 3
SIMILARITY = 0.6
LEAF_BITS = 20
#: Of a template: share of its units with a seed's form; share of its records that aren't mostly prose;
#: records and share of records with a message that make it a companion of messages.
SEEDED, LEAST_CORE, COMPANION_RECORDS, COMPANION_SHARE = 0.5, 0.1, 3, 0.9


def has_slot(text: str) -> bool:
    """Whether a sentence holds an unresolved slot and doesn't explain it."""
    breaks: list[re.Match[str]] | None = None
    for match in _SLOT.finditer(text):
        if breaks is None:
            breaks = list(_SENTENCE.finditer(text))
            ends = [m.end() for m in breaks]
        at = bisect.bisect_right(ends, match.start())
        start = ends[at - 1] if at else 0
        end = next((m.start() for m in breaks[at:] if m.start() >= match.end()), len(text))
        if _ABOUT.search(text, start, end):
            continue
        ahead, behind = text[start : match.start()].split()[-_BESIDE:], text[match.end() : end].split()[:_BESIDE]
        if not _EXPLAINS.search(" ".join(ahead)) and not _EXPLAINS.search(" ".join(behind)):
            return True
    return False


def has_filler(text: str) -> bool:
    """Whether a sentence is a filler template, or one of at least four words consists mostly of filler words."""
    low = text.lower()
    latin = any(w in low for w in _TELLING_FILLER)
    for sentence in _SENTENCE.split(low):
        if _FILLER_SENTENCE.match(sentence.strip()):
            return True
        words = _TOKEN.findall(sentence) if latin else ()
        if len(words) >= 4 and sum(w in _FILLER_WORDS for w in words) >= 0.75 * len(words) and len(_TELLING_FILLER.intersection(words)) >= 2:
            return True
    return False


#: First words of all forms of seeds; only units with one of them, or begun by no letter, are matched.
_OPENERS = frozenset(
    "please veuillez bitte you por enable activate activer activez aktivieren active activa habilite turn allow javascript script scripts "
    "cookie cookies your this ihr votre su noscript checking loading diese cette esta este http error erreur fehler status fatal warning "
    "exception traceback page seite página document file datei archivo fichier the access zugriff accès acceso permission forbidden "
    "unauthorised unauthorized bad not internal interner service gateway connection an a unexpected unknown server database system something oops "
    "cannot can could unable failed too session site under le el der servicio dienst request lorem add insert enter type place click text "
    "texte texto content description detail details sample dummy placeholder filler example blindtext platzhalter mustertext beispieltext "
    "contenido test coming tbd tba todo n asdf qwerty foo hier replace".split()
)
_FIRST = re.compile(r"[^\W\d_]+")
_TO_BE = re.compile(r"(?i)\bto be (?:supplied|provided|added|written)\b.{0,12}$")


def form_of(unit: str, follows: bool = True) -> str | None:
    """The kind of message whose form a unit has (`follows` for what messages are followed by), or None."""
    first = _FIRST.match(unit)
    if first is None or (word := first.group().lower()) in _OPENERS or word.startswith("xx"):
        for kind, pattern in _MESSAGES.items():
            if pattern.match(unit):
                return kind
    if "o be " in unit.lower() and _TO_BE.search(unit):
        return "filler"
    if _TRACE.match(unit):
        return "error"
    return "follows" if follows and _FOLLOWS.match(unit) else None


def units_of(text: str, follows: bool = True) -> Iterator[tuple[str, int, str | None]]:
    """(masked unit, words, form) of a record; headings, request marks and labels of menus are left out.

    A row of a table is one unit without a form, whatever its cells hold.
    """
    for line in text.split("\n"):
        line = line.strip()
        if not line or _HEADING.match(line) or _REQUEST.match(line):
            continue
        if _TABLE_ROW.match(line):
            yield "|", max(1, len(_TOKEN.findall(line))), None
            continue
        for part in _SEPARATOR.split(line):
            for unit in _SENTENCE.split(part):
                unit = unit.strip()
                if not unit:
                    continue
                size, form = len(unit.split()), form_of(unit, follows)
                if form or size > LABEL or unit.endswith((".", "!", "…", ":")):
                    yield _NUMBER.sub("0", unit), size, form


def leaf_of(unit: str, depth: int = DEPTH) -> tuple:
    """The path of a masked unit down the tree: its number of words and its first words, those with digits masked."""
    words = unit.split()
    return (len(words), *("*" if any(c.isdigit() for c in w) else w for w in words[:depth]))


def _leaf_code(unit: str) -> int:
    return zlib.crc32("\t".join(map(str, leaf_of(unit))).encode("utf-8", "surrogatepass")) - (1 << 31)


def _scan(rest: dict[str, list], texts: list[str]) -> dict[str, list]:
    out: dict[str, list] = {"src_table": [], "row_id": [], "direct": [], "leaves": [], "seeds": []}
    for key, row, text in zip(rest["src_table"], rest["row_id"], texts):
        hit = has_slot(text) or has_filler(text)
        units = [] if hit else [(_leaf_code(u), form) for u, _, form in units_of(text, follows=False) if u != "|"]
        if hit or units:
            out["src_table"].append(key)
            out["row_id"].append(row)
            out["direct"].append(hit)
            out["leaves"].append(list({leaf for leaf, _ in units}))
            out["seeds"].append(list({leaf for leaf, form in units if form}))
    return out


_UNITS = "src_table string, row_id long, unit string, size int, form string, seeded boolean, core boolean"


def _units(rest: dict[str, list], texts: list[str]) -> dict[str, list]:
    """Each different unit of each row with its words in all; whether the row holds a seed, and whether forms make up enough of it."""
    out: dict[str, list] = {"src_table": [], "row_id": [], "unit": [], "size": [], "form": [], "seeded": [], "core": []}
    for key, row, text in zip(rest["src_table"], rest["row_id"], texts):
        sizes: dict[tuple[str, str | None], int] = {}
        for unit, size, form in units_of(text):
            sizes[unit, form] = sizes.get((unit, form), 0) + size
        seeded = any(form and form != "follows" for _, form in sizes)
        core = sum(n for (_, form), n in sizes.items() if form) >= MOST_OTHER * sum(sizes.values())
        for (unit, form), size in sizes.items():
            for name, value in zip(out, (key, row, unit, size, form, seeded, core)):
                out[name].append(value)
    return out


class MessageTree:
    """A prefix tree of fixed depth whose leaves hold templates; words that differ become wildcards."""

    def __init__(self, depth: int = DEPTH, similarity: float = SIMILARITY) -> None:
        self.depth, self.similarity = depth, similarity
        self.leaves: dict[tuple, list[list[str]]] = {}

    def add(self, unit: str) -> tuple[tuple, int]:
        """The leaf of a unit and the number of the template there that it belongs to, merged with it."""
        words = unit.split()
        path = leaf_of(unit, self.depth)
        leaf = self.leaves.setdefault(path, [])
        for number, template in enumerate(leaf):
            if sum(a == b for a, b in zip(template, words)) >= self.similarity * len(words):
                for i, (a, b) in enumerate(zip(template, words)):
                    if a != b:
                        template[i] = "*"
                return path, number
        leaf.append(words)
        return path, len(leaf) - 1


_COUNTS = "n long, form string, with_seed long, with_core long"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units sorted by leaf through the tree; only the templates of the leaf at hand are kept."""
    tree, current = MessageTree(), None
    for batch in batches:
        names = []
        for unit, leaf in zip(batch.column("unit").to_pylist(), batch.column("leaf").to_pylist()):
            if leaf != current:
                tree, current = MessageTree(), leaf
            path, number = tree.add(unit)
            names.append(" ".join(map(str, path)) + f" #{number}")
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], names=[*batch.schema.names, "template"])


def _with_leaf(rest: dict[str, list], texts: list[str]) -> dict[str, list]:
    return rest | {"unit": texts, "leaf": [_leaf_code(u) for u in texts]}


def scan(rows: DataFrame) -> DataFrame:
    """(src_table, row_id, direct, leaves, seeds): whether a row has a slot or filler, else its leaves and those of its seeds; a written table."""
    scanned = map_text(
        rows.select("src_table", "row_id", "text"),
        "src_table string, row_id long, direct boolean, leaves array<int>, seeds array<int>",
        _scan,
    )
    return write_table(scanned, "residue-scan")


def mined_rows(scanned: DataFrame) -> DataFrame:
    """(src_table, row_id) of the rows with a unit in a leaf that a seed falls into.

    The leaves with seeds are marked in a set of 2 ** LEAF_BITS bits, whose size doesn't depend on the
    data; where two leaves share a bit a row too many is mined, never one too few.
    """
    bit = F.col("leaf").bitwiseAND((1 << LEAF_BITS) - 1)
    hit = scanned.select(F.explode("seeds").alias("leaf")).select(bit.alias("bit")).distinct()
    marks = np.zeros(1 << LEAF_BITS, bool)
    marks[[r["bit"] for r in hit.collect()]] = True  # at most 2 ** LEAF_BITS numbers
    shared = scanned.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def keep(batch: pa.RecordBatch) -> dict[str, object]:
        marks = np.unpackbits(shared.value).astype(bool)
        leaves = batch.column("leaves")
        flat = marks[leaves.flatten().to_numpy(zero_copy_only=False) & ((1 << LEAF_BITS) - 1)]
        ends = np.cumsum(pc.list_value_length(leaves).to_numpy(zero_copy_only=False))
        total = np.concatenate(([0], np.cumsum(flat)))
        kept = np.flatnonzero(total[ends] > total[np.concatenate(([0], ends[:-1]))])
        return {c: batch.column(c).take(pa.array(kept)) for c in ("src_table", "row_id")}

    return map_batches(scanned.where(~F.col("direct")).select("src_table", "row_id", "leaves"), "src_table string, row_id long", keep)


def templates(units: DataFrame) -> DataFrame:
    """(unit, n, form, with_seed, with_core, leaf, template): each different unit with its template; a written table.

    Shuffled and sorted by the leaf itself, so that templates don't depend on the number of partitions.
    """
    once = units.where(F.col("unit") != "|").groupBy("unit").agg(
        F.count("*").alias("n"), F.max("form").alias("form"), F.count_if("seeded").alias("with_seed"), F.count_if("core").alias("with_core")
    )
    leaves = map_text(once.withColumnRenamed("unit", "text"), f"unit string, {_COUNTS}, leaf int", _with_leaf)
    placed = leaves.repartition("leaf").sortWithinPartitions("leaf", "unit")
    return write_table(placed.mapInArrow(_place, f"unit string, {_COUNTS}, leaf int, template string"), "message-templates")


def verdicts(placed: DataFrame, scanned: DataFrame) -> DataFrame:
    """(template, kind, message, belongs): the verdict on each template, from all units it holds; a written table."""
    n, form = F.col("n"), F.col("form")
    covered = placed.groupBy("leaf", "template").agg(
        F.sum("n").alias("records"), F.max(F.when(form != "follows", form)).alias("kind"),
        (F.sum(F.when(form != "follows", n).otherwise(0)) >= SEEDED * F.sum("n")).alias("seeded"),
        (F.sum(F.when(form == "follows", n).otherwise(0)) >= SEEDED * F.sum("n")).alias("follows"),
        F.sum("with_seed").alias("with_seed"), F.sum("with_core").alias("with_core"),
    )
    covered = write_table(covered, "message-covered")
    message = F.col("seeded") & (F.col("with_core") >= LEAST_CORE * F.col("records"))
    recurs = ~F.col("seeded") & ~F.col("follows") & (F.col("with_seed") >= COMPANION_RECORDS) & (F.col("with_core") >= COMPANION_SHARE * F.col("records"))
    doubtful = covered.where(recurs).select("leaf").distinct()
    # a leaf has at least as many rows as each of its templates, so the share is never overrated
    everywhere = scanned.select(F.explode("leaves").alias("leaf")).join(doubtful, "leaf", "left_semi").groupBy("leaf").agg(F.count("*").alias("everywhere"))
    companion = F.coalesce(recurs & (F.col("with_seed") >= COMPANION_SHARE * F.col("everywhere")), F.lit(False))
    judged = covered.join(everywhere, "leaf", "left").select(
        "template", F.when(message, F.col("kind")).alias("kind"), message.alias("message"), (message | F.col("follows") | companion).alias("belongs")
    )
    return write_table(judged, "message-verdicts")


def find_residue(rows: DataFrame) -> DataFrame:
    """(src_table, row_id) of the rows to exclude."""
    row = ["src_table", "row_id"]
    scanned = scan(rows)
    mined = write_table(mined_rows(scanned), "message-rows")
    units = write_table(map_text(likely_rows(rows.select(*row, "text"), mined, row).join(mined, row, "left_semi"), _UNITS, _units), "message-units")
    placed = templates(units)
    judged = placed.join(verdicts(placed, scanned), "template").select("unit", "n", "message", "belongs")
    decided = join_groups(units, write_table(judged, "message-judged"), ["unit"], "n", "left").groupBy(*row).agg(
        F.max("message").alias("hit"), F.sum("size").alias("_all"),
        F.sum(F.when(F.coalesce("belongs", F.lit(False)), 0).otherwise(F.col("size"))).alias("_other"),
    )
    messages = decided.where(F.col("hit") & (F.col("_other") <= F.greatest(F.lit(FEW_OTHER), MOST_OTHER * F.col("_all"))))
    return scanned.where("direct").select(*row).unionByName(messages.select(*row))


def keep_content(rows: DataFrame) -> DataFrame:
    """The rows that hold content: all but those of `find_residue`, with all their columns."""
    return rows.join(find_residue(rows), ["src_table", "row_id"], "left_anti")
