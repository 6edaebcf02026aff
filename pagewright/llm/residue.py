"""Template residue, filler and error pages (problem 8).

Method: texts are taken apart into lines and sentences; addresses, dates and numbers
in them are masked, and equal masked texts are grouped across documents and sources.
Each distinct message is then classified once, by placeholder and phrase rules; short
messages that mean little alone count only if they recur in several documents.

Recurrence cannot be asked of all messages: most residue stands behind a title or
holds a name, so that its message occurs once (README has the figures). A rule is
tried only on messages with one of the literals that every match of it must hold; one
automaton finds the literals of all rules in one pass, which no expression does, so
distinct messages, and only those, go to Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import plain_space
from pagewright.runtime import HEAVY_PARTS, materialize, split_join

SEGMENT_END = r"(?s)(?:\n|[ ](?<=[.!?…].))[ \n]*+"
#: Residue messages that are broadcast at most; more of them are joined by shuffle.
MAX_BROADCAST = 500_000

# What stands for a field's name: words joined by _ . or -, at least three letters in all.
NAME = r"[$]?[\p{L}_][\p{L}\p{N}]+(?:[_.-][\p{L}\p{N}]+)*"
FIELD = rf" *{NAME} *"

# A rule is a pattern with the literals, in lower case, of which every match holds at least one.

Rule = tuple[tuple[str, ...], str]

#: Template fields left open, in the marks of common template languages.
PLACEHOLDERS: list[Rule] = [
    (("{{",), rf"\{{\{{\{{?[#/&>^!]?{FIELD}(?:\|[^{{}}]*)?\}}\}}\}}?"),
    (("{%",), rf"\{{%-? ?{NAME}[^%{{}}]* ?-?%\}}"),
    (("[%",), rf"\[%{FIELD}%\]"),
    (("<%",), rf"<%[=-]?{FIELD}%>"),
    (("<?",), rf"<\?(?:=|php echo)?{FIELD};? ?\?>"),
    (("${", "#{"), rf"[$#]\{{{FIELD}\}}"),
    (("{$",), rf"\{{[$]{NAME}\}}"),
    (("[[",), rf"\[\[{FIELD}\]\]"),
    (("<<",), rf"<<{FIELD}>>"),
    (("«",), rf"«(?:{NAME})»"),
    (("%",), rf"(?<![\p{{L}}\p{{N}}%])%%?{NAME}%%?(?![\p{{L}}\p{{N}}%])"),
    (("@@",), rf"@@{NAME}@@"),
    (("~~",), rf"~~{NAME}~~"),
    (("__",), rf"(?<![\p{{L}}\p{{N}}_])__[\p{{L}}](?:[\p{{L}}\p{{N}}.-]|_(?!_))*__(?![\p{{L}}\p{{N}}_])"),
    (("$",), rf"(?<![\p{{L}}\p{{N}}$])[$](?=\p{{L}}{{3}}){NAME}[$](?![\p{{L}}\p{{N}}])"),
]
#: A single brace is also a set or code: then the text around it must be no program.
SINGLE_BRACE = rf"(?<![\p{{L}}\p{{N}}\{{$#])\{{(?=\p{{L}}{{3}}){NAME}\}}(?!\}})"
PROGRAM = r"""\b(?:print|printf|println|format|input|def|return|echo|console\.log)\b ?\(?|[fF]["'].*\{|[;=] *["']|\bfor \w+ in\b"""

BROKEN_OBJECT = r"(?:\[|%[05]b)object(?: |\+|%2?0)object(?:\]|%[05]d)"
GREETING = r"hello|hi|dear|hola|bonjour|cher|chère|estimad[oa]s?|querid[oa]s?"
#: Fields filled with an empty or broken machine value.
VALUES: list[Rule] = [
    (("object",), BROKEN_OBJECT),
    (("<url>",), r"<url>(?:undefined|null|nan)(?![\p{L}\p{N}_-])"),
    (("null", "undefined", "nan", "none"), r"\b(?:hello|hi|dear|welcome(?: back)?|hola|bonjour|unit|lesson|grade|page|class|chapter|section|week|by|for|of|at),? \(?(?:null|undefined|nan|none)\)?(?=[\s,.!:;)]|$)"),
    (("null", "nan of", "undefined"), r"\(null\)|<null>|\bnan of \w+|\bundefined of\b"),
    (("null", "undefined", "nan"), r"^\W*(?:null|undefined|nan)(?:\W+(?:null|undefined|nan))*\W*$"),
    (("#",), r"#(?:ref|value|name|div/0)[!?]|#n/a\b"),
    ((",",), rf"^ ?(?:{GREETING}) ?,"),
    ((" .", " ,"), r"\p{L} [.,](?: |$)"),
    (("&nbsp;", "[no "), r"&nbsp;|\[no (?:title|name|text|content|caption)\]"),
    (("array",), r"\barray ?\( ?\[\d+\] ?=>"),
    (("missing", "."), r"\bmissing (?:translation|string|key)\b ?:|^\W*(?-i:\p{Ll}+(?:\.\p{Ll}+){2,})\W*$|^\W*\p{L}{2,}(?:\.\p{L}{2,}){2,}\W*$"),
    (("missing", "undefined"), r"\b(?:missing|undefined) (?:value|variable|field) ?:"),
]
THING = r"[\p{L}\p{N} ''’_-]{2,40}"
#: An instruction in brackets may also stand inside an address.
BRACKETED = rf"[\[<(] ?(?:insert|insertar|insérer|inserer|add|enter|type|put|compléter|completer|completar|ajouter|añadir|escribir|your|votre|su)\b ?:? ?{THING}[\])>]"
#: Instructions to put content in.
INSTRUCTIONS: list[Rule] = [
    (("[", "<", "("), BRACKETED),
    (("to be ", "placeholder", "goes here", "à ", "por "), rf"[\[<(]{THING} (?:to be (?:added|written|completed|inserted|confirmed)|placeholder|goes here|à (?:compléter|venir|ajouter)|por (?:completar|añadir))[\])>]"),
    (("goes here",), rf"\b{THING} goes here\b"),
    (("todo", "fixme", "tbc"), r"\btodo ?[:-]|\b(?:fixme|tbc) ?[:-]"),
    (("tbd",), r"\btbd\b ?[-–—:]"),
    (("type your ",), rf"\btype your {THING} here"),
    (("click ",), r"\bclick (?:here )?to (?:add|edit|enter|insert)\b"),
    (("**",), rf"\*{{2,}} ?(?:replace|insert|add|change|fill in)\b{THING}\*{{2,}}"),
    (("replace ",), rf"\breplace (?:this|with) (?:text|{THING} \*{{2,}})"),
    (("xxx",), rf"\bx{{3,}} {THING} x{{3,}}"),
    (("your ",), rf"\byour {THING} here\b"),
    (("to follow",), r"\b(?:text|texto|texte|content|contenido|contenu) to follow\b|\bto follow ?$"),
]
# The printers' filler passage and the further words of common generators of it.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa "
    "qui officia deserunt mollit anim id est laborum "
    "vestibulum pellentesque phasellus curabitur suspendisse maecenas vivamus aliquam praesent quisque nullam nunc mauris morbi "
    "donec etiam proin sodales ultrices faucibus posuere cubilia curae tincidunt volutpat convallis dapibus egestas euismod "
    "fermentum feugiat gravida hendrerit iaculis imperdiet interdum lacinia lacus laoreet lectus leo libero ligula lobortis luctus "
    "malesuada massa mattis metus molestie neque nibh nisl odio orci ornare pharetra placerat porta porttitor pretium pulvinar "
    "purus rhoncus risus rutrum sagittis sapien scelerisque sem semper sollicitudin tellus tempus tortor tristique turpis urna "
    "varius vehicula vel venenatis vitae viverra vulputate fusce cursus erat justo integer"
).split()
#: Those that are no words of the languages of the corpus; a run of filler holds one of them.
LATIN_ONLY = tuple(w for w in LATIN if len(w) > 3 and w not in ("magna", "porta", "minim", "massa", "enim", "esse", "cursus", "integer", "justo", "dolor", "dolore", "culpa", "libero"))
_latin = "|".join(LATIN)
_only = "|".join(LATIN_ONLY)
#: Filler: a run of five words or more of printers' Latin.
FILLER: list[Rule] = [
    (LATIN_ONLY, rf"(?=(?:\p{{L}}+[ ,.]+){{0,4}}(?:{_only})\b)\b(?:{_latin})\b(?:[ ,.]+(?:{_latin})\b){{4,}}"),
    (("lorem ipsum",), r"^\W*lorem ipsum\b[\W\p{L}]*$"),
]
#: One word, or a pair of words, many times; tried on messages with so many words that occur again.
REPEATED = (r"(?:^| )(\p{L}{2,})(?:[ ,.]+\1(?!\p{L})){4,}", r"(?:^| )(\p{L}{2,} \p{L}{2,})(?:[ ,.]+\1(?!\p{L})){3,}")
REPEATS = 4

CODE = r"[45]\d\d"
#: What the answers of servers are called.
STATUS = (
    r"(?:internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|(?:page |file )?not found|gone|forbidden|"
    r"access (?:is )?denied|unauthori[sz]ed|bad request|too many requests|request time-?out|conflict|"
    r"(?:unexpected|unknown|internal|fatal) (?:server )?(?:failure|error))"
)
PART = r"(?:server|upstream|gateway|back ?end|service|site|system|application|app|page|lesson|unit|content|file|resource|request|connection|session|link)"
#: A part of a site with what became of it, or what the reader did wrong.
FAILED = (
    rf"(?:(?:the|this|your|our) {PART} (?:(?:did|does|do) not (?:answer|respond|reply|exist)|(?:was|has been|is) (?:removed|moved|deleted|gone|unavailable|blocked|disabled)|"
    r"(?:has )?(?:timed out|expired|failed|crashed)|(?:could not|cannot|can['’]t) be (?:found|reached|loaded|opened|displayed)|ran into (?:a problem|an error)|you requested is not here)|"
    r"you (?:are sending|have sent|sent) (?:too many )?requests(?: too (?:quickly|fast|often))?|nothing (?:to see|found|was found)(?: (?:at|on) this (?:address|page|link))?|"
    r"you do not have permission to (?:view|access|see|open|use|edit) (?:this|the) \p{L}+|(?:down|closed) for maintenance)"
)
#: Messages of sites and programs that they failed.
ERRORS: list[Rule] = [
    (("4", "5"), rf"\b(?:error|http|status|code|fehler|erreur)(?: code)?[ :/#-]*{CODE}\b"),
    (("4", "5"), rf"(?:^|[^\p{{L}}\p{{N}}]){CODE} ?[:–—-]* ?(?:{STATUS}|{FAILED})"),
    (("4", "5"), rf"(?:^|[^\p{{L}}\p{{N}}]){CODE} ?[:–—-]* ?(?-i:(?=\p{{Lu}}))(?:the|you|your|this|nothing|sorry)\b[^\d]{{0,60}}$"),
    (("4", "5"), rf"{STATUS} ?\((?:code|error|http|status)? ?{CODE}\)"),
    (("error", "gateway", "unavailable", "out", "found", "gone", "forbidden", "denied", "unauthori", "request", "conflict", "failure"), rf"^\W*{STATUS}\b[^\p{{L}}]*(?:back soon)?\W*$"),
    (("the ", "this ", "your ", "our ", "you ", "nothing", "maintenance"), rf"^\W*{FAILED}\b[^\p{{L}}]*(?:back soon)?\W*$"),
    (("you do not have permission",), r"\byou do not have permission to (?:view|access|see|open) this\b"),
    (("maintenance", "server error", "bad gateway"), r"\bdown for maintenance, back soon\b|\binternal server error\b|\bbad gateway\b"),
    (("sorry",), r"\bsorry, (?:we|but we) (?:can(?:'|’)?t|cannot|could not|couldn(?:'|’)t) (?:find|load|open|show)\b"),
    (("lo sentimos", "désolé", "sorry"), r"\b(?:lo sentimos|désolés?|sorry), (?:ha ocurrido|une erreur|something|an error|no (?:se )?(?:pud|encontr|hemos)|la page|nous n)"),
    (("ha ocurrido un error", "une erreur", "error"), r"\bha ocurrido un error\b|\bune erreur (?:est survenue|s['’]est produite|inattendue)|\ban (?:unexpected )?error (?:has )?occurred\b"),
    (("no encontrada", "introuvable", "non trouvée", "the page you"), r"\bpágina no encontrada\b|\bpage (?:introuvable|non trouvée)\b|\bthe page you (?:requested|are looking for|were looking for)\b"),
    (("the link you", "been moved"), r"\bthe link you followed (?:may|might) be\b|\bmay have been moved\b.{0,12}$"),
    (("something went wrong", "oops"), r"\bsomething went wrong\b(?: on our (?:side|end))?[.!]|^\W*oops[.!…]*$|(?:^|\s)oops!$"),
    (("we could",), r"\bwe could(?: not|n['’]t) (?:load|find|open|display|complete) (?:this|the|your)\b"),
    (("your session", "sign in again"), r"\byour session has (?:expired|timed out|ended)\b|\bsign in again to continue\b"),
    (("request timed", "connection "), r"\brequest timed out\b|\bconnection (?:timed out|was reset|refused)\b|\bdatabase connection (?:could not|failed)"),
    (("fatal", "parse error", "warning:", "overflow at", "segmentation"), r"\bfatal error ?:|\bparse error ?:|\bwarning: (?:cannot|undefined|failed|mysql|include|require|division)|\bstack overflow at\b|\bsegmentation fault\b"),
    (("traceback", "error", "exception", "file \"", "on line "), r"\btraceback \(most recent call last\)|^\W*(?:\w+\.)*\w*(?:error|exception): .{0,80}$|\bfile \"[^\"]+\", line \d+|\bon line \d+$|\buncaught \w*(?:error|exception)\b"),
    (("try again", "réessayer", "intent", "check back"), r"\bplease try again (?:later|in a (?:few|moment))|\bveuillez réessayer\b|\b(?:inténtelo|intente) (?:de nuevo|más tarde|otra vez)\b|\bcheck back soon\b"),
    (("construction", "maintenance", "construcción", "mantenimiento"), r"\b(?:this )?(?:site|page) is (?:currently )?(?:under construction|down for maintenance)\b|\bsitio en (?:construcción|mantenimiento)\b|\bsite en (?:construction|maintenance)\b"),
    (("available",), r"\b(?:this|the) (?:content|lesson|page|video|resource|unit) is (?:not (?:currently )?available|(?:currently |temporarily )?unavailable)\b"),
    (("disponible",), r"\bno (?:está|se encuentra) disponible en (?:su|tu) (?:región|país)\b|\bn['’]est pas disponible dans votre\b"),
]
#: Notices that scripts, cookies or a browser check are needed.
SCRIPT = r"(?:java ?script|scripts?|scripting|cookies)"
SCRIPTS: list[Rule] = [
    (("script", "cookies"), rf"\b(?:you need to|please|you must|must) (?:enable|activate|turn on|allow|switch on) {SCRIPT}\b"),
    (("script", "cookies"), rf"\b{SCRIPT}(?: and {SCRIPT})? (?:is|are|must be|needs? to be|has to be|have to be) (?:disabled|turned off|required|enabled|allowed|activated|switched on|blocked)\b"),
    (("script", "cookies"), rf"\bthis (?:app|page|site|reader|viewer|lesson|unit|content|website) (?:needs|requires|works only with|uses) {SCRIPT}\b"),
    (("script", "cookies"), r"\bexige que (?:javascript|les (?:scripts|cookies))\b|\b(?:activez|activer) (?:javascript|les (?:scripts|cookies))\b|\bjavascript (?:soit|est|doit être) (?:activé|désactivé)"),
    (("navegador", "script", "cookies"), r"\b(?:active|habilite|activa|permita) (?:su navegador|javascript|las cookies|los scripts)\b|\bpara permitir javascript\b|\bnecesita (?:activar|habilitar) (?:javascript|las cookies)\b"),
    (("script", "without"), rf"\b(?:switch|turn) on {SCRIPT}\b|\bnoscript ?:|\bscript support required\b|\b(?:will|does|do|can|may) not (?:load|work|open|run) without (?:it|them|{SCRIPT})\b"),
    (("checking ", "you are ", "robot"), r"\bchecking (?:your|if the) (?:browser|connection)\b|\bverify(?:ing)? (?:that )?you are (?:not a robot|human)\b|\bprove that you are (?:not a robot|human)\b"),
    (("browser", "ddos", "robot", "navigateur"), r"\byour browser (?:does not|doesn['’]t|is not|isn['’]t) (?:support|supported)|\bddos protection by\b|\bcompruebe que no es un robot\b|\bvérification de votre navigateur\b"),
]
#: The kinds in the order in which they are tried.
KINDS = {"placeholder": PLACEHOLDERS, "value": VALUES, "instruction": INSTRUCTIONS, "filler": FILLER, "error": ERRORS, "script": SCRIPTS}
#: Kinds of messages that are none where they are quoted.
SPOKEN = ("error", "script")
#: Short messages that count only if they recur in more than one document.
RECURRING: Rule = (
    ("retry", "coming soon", "available", "please wait", "try later"),
    r"^\W*(?:retry\??|page not available|coming soon|(?:try|come) (?:again )?later|loading[.…]+ please wait)\W*$")

#: Texts that only speak of such things: what stands in quotation marks is no message.
QUOTED = r"“[^”]{1,80}”|\"[^\"]{1,80}\""


#: Where an address holds a field left open or a broken value; from there on it is kept.
OPEN = "|".join([*(p for _, p in PLACEHOLDERS), SINGLE_BRACE, BROKEN_OBJECT, BRACKETED, r"(?<=[/=])(?:undefined|null|nan)(?![^/?&#\s.,;:!)])"])

DATE = r"\b\d{1,4}([-/.])\d{1,2}\1\d{1,4}\b"
#: Runs of digits but for status codes, which tell errors.
NUMBER = r"\d+(?<!(?<!\d)[45]\d\d(?!\d))(?!\d)"


def mask(c: Column) -> Column:
    """Addresses, dates and numbers as fixed marks; three-digit status codes stay, as they tell errors.

    An address ends before a field left open in it, so that the rules see the field.
    """
    web = F.regexp_replace(c, rf"(?iu)\b(?:https?://|www\.)(?:(?!{OPEN})\S)*+", "<url>")
    web = F.regexp_replace(web, rf"(?iu)\b(?:(?!{OPEN})[\w.+-])+@[\w-]+\.[a-z]{{2,}}\b", "<mail>")
    has_web = F.contains(c, F.lit("://")) | F.contains(c, F.lit("www.")) | F.contains(c, F.lit("@"))

    def numbers(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, DATE, "<date>"), NUMBER, "0")

    return F.when(has_web, numbers(web)).when(F.regexp(c, F.lit("[0-9]")), numbers(c)).otherwise(c)


def tidy(c: Column) -> Column:
    return F.trim(F.when(F.contains(c, F.lit("  ")), F.regexp_replace(c, " +", " ")).otherwise(c))


def messages(documents: DataFrame) -> DataFrame:
    """(doc_id, source, message): the distinct masked lines and sentences of each document; each is masked once, before it is a row."""
    pieces = F.split(plain_space("text"), SEGMENT_END)
    masked = F.array_distinct(F.transform(pieces, lambda x: tidy(mask(x))))
    return documents.filter(F.length("text") > 0).select("doc_id", "source", F.explode(masked).alias("message")).filter(F.length("message") > 1)


class Rules:
    """All rules behind one automaton of their literals."""

    def __init__(self):
        import ahocorasick
        import regex

        flags = regex.IGNORECASE | regex.UNICODE
        self.automaton = ahocorasick.Automaton()
        self.rules: list[tuple[str, regex.Pattern, bool]] = []
        held: dict[str, set[int]] = {}
        for kind, rules in [("brace", [(("{",), SINGLE_BRACE)]), *KINDS.items(), ("recurring", [RECURRING])]:
            for literals, pattern in rules:
                for x in literals:
                    held.setdefault(x, set()).add(len(self.rules))
                self.rules.append((kind, regex.compile(pattern, flags), kind in SPOKEN))
        for x, which in held.items():
            self.automaton.add_word(x, frozenset(which))
        self.automaton.make_automaton()
        self.program, self.quoted = regex.compile(PROGRAM), regex.compile(QUOTED)
        self.repeated = [regex.compile(p, flags) for p in REPEATED]

    def kind(self, message: str) -> str | None:
        """The kind of residue that a message is, "recurring" for one that must recur, or None."""
        low = message.lower()
        near = set().union(*(which for _, which in self.automaton.iter(low)))
        said = None
        for k in sorted(near):
            kind, pattern, spoken = self.rules[k]
            if spoken and said is None:
                said = self.quoted.sub("", message)
            if pattern.search(said if spoken else message):
                if kind == "brace":
                    if self.program.search(message):
                        continue
                    return "placeholder"
                return kind
        ws = low.replace(",", " ").replace(".", " ").split()
        if len(ws) - len(set(ws)) >= REPEATS and any(p.search(message) for p in self.repeated):
            return "filler"
        return None


def kinds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    rules = Rules()
    for batch in batches:
        yield pd.Series([rules.kind(m) for m in batch], dtype="object")


def classified(documents: DataFrame) -> DataFrame:
    """The residue among the distinct messages: message, n_docs, n_sources, kind; a null source is none."""
    # Counts are combined on the map side per message and source, then over the sources.
    per_source = messages(documents).groupBy("message", "source").agg(F.count(F.lit(1)).alias("n"))
    groups = per_source.groupBy("message").agg(F.sum("n").alias("n_docs"), F.count("source").alias("n_sources"))
    # The rules depend on the message only, so the optimizer would try them on every occurrence, below the grouping; marked as not deterministic they stay above it.
    kind = F.pandas_udf(kinds, "string").asNondeterministic()
    bad = groups.withColumn("kind", kind("message")).filter(F.col("kind").isNotNull() & ((F.col("kind") != "recurring") | (F.col("n_docs") > 1)))
    return bad.withColumn("kind", F.when(F.col("kind") == "recurring", "error").otherwise(F.col("kind")))


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, kind): the kinds of residue each document holds. Null and empty texts hold none.

    The documents' messages meet the residue where they lie, by a broadcast of its
    hashes if they are at most MAX_BROADCAST; else by shuffle, with the messages that
    hold a large part of all their occurrences split off.
    """
    hashed = [F.xxhash64("message").alias("h1"), F.xxhash64(F.lit("second"), "message").alias("h2")]
    bad = materialize(classified(documents).select(*hashed, "kind", "n_docs"))
    every = messages(documents).select("doc_id", *hashed)
    n, total = bad.agg(F.count(F.lit(1)), F.sum("n_docs")).first()
    if n <= MAX_BROADCAST:
        met = every.join(F.broadcast(bad.select("h1", "h2", "kind")), ["h1", "h2"])
    else:
        heavy = bad.filter(F.col("n_docs") * HEAVY_PARTS > total).select("h1", "h2")
        met = split_join(every, bad.select("h1", "h2", "kind"), ["h1", "h2"], heavy)
    return met.select("doc_id", "kind").distinct()


def found(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents that hold residue."""
    return residue(documents).select("doc_id").distinct()


def clean(documents: DataFrame) -> DataFrame:
    """The documents that hold none."""
    return documents.join(found(documents), "doc_id", "left_anti")


def message_report(documents: DataFrame) -> DataFrame:
    """(message, kind, n_docs, n_sources) of every distinct residue message."""
    return classified(documents).select("message", "kind", "n_docs", "n_sources")
