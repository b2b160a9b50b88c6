"""Template residue and failed pages in a corpus.

Normalised lines are counted by host. Lines that recur over a host are its
boilerplate and are taken off each record that has content beside them (a
failed page recurs too, but has none). What is left is searched for evidence: unfilled
placeholders, filler, error messages of a site, and notices about scripts,
cookies or a browser check. Code and sentences of a person who writes about
such things are no evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.words import words
from millrace.llm.language import ANY_STOPWORD
from millrace.llm.prefilter import Prefilter
from millrace.session import BROADCAST_BYTES, ROW_BYTES, broadcast_if_small, materialised, spread

#: Words of a line of its own that make a record more than its host's recurrent lines.
CONTENT_WORDS = 5

KINDS = ("placeholder", "filler", "error", "script_notice")

# --- fixed values: markers in English, Spanish, French and German ---

HTML_TAGS = "a abbr article aside b blockquote body br button center code div em footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input label li link main meta nav noscript ol option p pre script section select small span strong style sub sup table tbody td th thead title tr u ul"
DUNDERS = "init name main file call str repr len dict doc all version getitem setitem class new iter next enter exit eq hash slots module author future"
FILLER_LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua veniam nostrud exercitation ullamco laboris nisi aliquip commodo consequat"

#: A person tells about the matter: no message of a site.
NARRATIVE = re.compile(r"(?<![\w'’])(?:i|i'm|i've|i'd|i'll|my|ich|mein\w*|je|j['’]ai|mon|yo|mi|mis)(?![\w'’])")

PLACEHOLDERS = [
    re.compile(r"\{\{[^{}\n]{1,80}\}\}"),
    re.compile(r"\{%[^%{}\n]{1,80}%\}"),
    re.compile(r"<<\w[\w .]{0,40}>>"),
    re.compile(r"<\?[^?<>\n]{1,60}\?>"),
    re.compile(r"\((?:your|insert|enter) [\w. ]{1,40} here\)", re.I),
    re.compile(r"<%[=\-]?[^%]{1,80}%>"),
    re.compile(r"[$#]\{[^{}\n]{1,80}\}"),
    re.compile(r"(?<![\w%])%[A-Z][A-Z0-9_]{2,}%(?![\w%])"),
    re.compile(r"\[\[[^\[\]\n]{1,80}\]\]"),
    re.compile(r"\[(?:[A-Z]{2,}[A-Z0-9]*(?:[ _-][A-Z0-9]+)+)\]"),
    re.compile(r"\[(?:your|insert|enter|add|type|tu|su|votre|ihr|ihre|dein)\b[^\[\]\n]{1,60}\]", re.I),
    re.compile(r"@@\w[\w .]{0,40}@@"),
    re.compile(r"\b(?:dear|hello|hi|hola|estimad[oa]|cher|chère|bonjour|hallo|liebe[r]?|geehrte[r]?|sincerely|regards|saludos|cordialement|grüße[n]?),? ?(?:\{[A-Za-z_][\w. ]{1,40}\}|\[[A-Za-z][\w. ]{1,40}\]|%[A-Za-z][\w. ]{1,30}%)", re.I),
    re.compile(r"^(?:[A-Za-z][\w ]{1,30}: ?(?:\{[A-Za-z_][\w. ]{1,40}\}|\[[A-Za-z][\w. ]{1,40}\]|%[A-Za-z][\w. ]{1,30}%)|\{[A-Za-z_][\w. ]{1,40}\}|%[A-Za-z][\w. ]{1,30}%)[.,;!]?$"),
]
#: Forms that text may hold once for other reasons: two of one form and sign in a passage are placeholders, wherever they stand in it.
PAIRED = [
    re.compile(r"(?<![\w:]):[A-Za-z][\w. ]{1,30}:(?![\w:])"),
    re.compile(r"(?<![\w:'\"\])])\[[A-Za-z][\w. ]{1,30}\](?![\w(\[:])"),
    re.compile(r"(?<![\w%])%[A-Za-z][\w. ]{1,30}%(?![\w%])"),
    re.compile(r"(?<![\w$])\$[A-Za-z_][\w. ]{2,30}\$(?![\w$])"),
    *(re.compile(rf"(?<!\S){re.escape(sign)}[A-Za-z_][\w. ]{{2,30}}{re.escape(sign)}(?!\w)") for sign in ("==", "||", "##", "^", "!", "#", "@")),
    re.compile(r"\{\d{1,2}\}"),
    re.compile(r"(?<![\w'\"/(=$#])\{[A-Za-z_][\w. ]{1,40}\}(?!['\"])"),
    re.compile(r"~~\w+(?: \w+)?~~"),
]
ANGLE = re.compile(r"<([A-Za-z][A-Za-z0-9]*(?:[_ .-][A-Za-z0-9]+)*)>")
DUNDER = re.compile(r"(?<!\w)__([A-Za-z][A-Za-z0-9]*(?:[_ .][A-Za-z0-9]+)*)__(?!\w)")
GUILLEMETS = re.compile(r"«\s?([^«»]{1,40}?)\s?»")
NAME_FORM = re.compile(r"[A-Z0-9_ .]{2,}|\w+[_.]\w+|[a-z]+[A-Z]\w*")
UNFILLED = re.compile(
    r"\b(?:tbd|tba|tbc|x{3,}|to be (?:completed|determined|filled|defined|added)|(?:todo|fixme):? (?:fill|add|write|complete)\b"
    r"|por (?:completar|definir)|à (?:compléter|définir)|noch (?:auszufüllen|zu ergänzen|offen))\b",
    re.I,
)
FIELD_UNFILLED = re.compile(r"\b\w+ ?: ?(?:tbd|tba|tbc|todo\b[^.;/]*|x{3,}|to be \w+|n\.?n\.?|\?\?+|\.\.\.)(?=[.;/,\s]|$)", re.I)

FILLER = [
    re.compile(r"\b([^\W\d_]{2,})(?:[ ,]+\1){3,}\b"),
    re.compile(r"\b(?:asdf\w*|qwerty\w*|foo bar baz|bla bla bla|blah blah(?: blah)?)\b"),
    re.compile(r"\byour (?:\w+ )?(?:description|text|title|content|copy|headline|heading|name|caption|summary|message|answer|paragraph) (?:goes|comes|will go|will appear|belongs|should go) here\b"),
    re.compile(r"\b(?:insert|enter|add|put|place|type|write|paste|replace) (?:your |some |the |this )?(?:own )?(?:body )?(?:copy|text|content|title|description|caption|paragraph|heading|headline|summary)(?: \w+)?(?: \w+)? (?:here|in(?:to)? this (?:box|field|block|area|section)|with your own)\b"),
    re.compile(r"\b(?:this is (?:a |an? )?(?:placeholder|sample|dummy|example)(?: text| paragraph| content| page)?|(?:placeholder|dummy|sample) (?:text|content|copy|paragraph)(?: here)?[.!:]?$)"),
    re.compile(r"\b(?:placeholder (?:paragraph|text|sentence|content|page)\b|replace (?:it|this|me) with your own\b|texte de remplissage|texto de relleno|blindtext\b|(?:qwer|asdf)(?: (?:qwer|asdf))+)"),
    re.compile(r"\b([^\W\d_]{2,} [^\W\d_]{2,})(?: \1){3,}"),
    re.compile(r"\b(?:click|double.click|tap) (?:here )?to (?:edit|add|change) (?:this |your |a |the )?(?:text|title|content|description|paragraph)\b"),
    re.compile(r"\b(?:aquí va (?:su|tu|el) (?:texto|descripción|título)|(?:escriba|inserte|introduzca|escribe|inserta) (?:aquí )?(?:su|tu|el) (?:texto|descripción|título)|texto de (?:relleno|ejemplo|prueba)[.:]?$)"),
    re.compile(r"\b(?:votre (?:texte|description|titre) ici|(?:insérez|saisissez|ajoutez|écrivez) (?:ici )?(?:votre|le|un) (?:texte|description|titre)|texte (?:de remplissage|d'exemple|factice)[.:]?$)"),
    re.compile(r"\b(?:(?:hier|dein|ihr) (?:steht|kommt|text hier|beschreibung hier|steht ihr|steht dein)\b.{0,20}(?:text|beschreibung|titel|hier)|(?:fügen sie|füge) (?:hier )?(?:ihren|deinen|den) text|(?:blindtext|beispieltext|platzhaltertext)[.:]?$)"),
]

CODE_WORDS = r"(?:error|http|https|status|code|fehler|erreur|fallo|estado)"
ERROR = [
    re.compile(rf"(?:^|[!?:|] ?){CODE_WORDS}(?: (?:error|code|status))?\s*[:#\-–]?\s*(?:4[0-5]\d|50\d|52\d)\b"),
    re.compile(r"^(?:4[0-5]\d|50\d|52\d)\s*(?:[:\-–—.]|error|not found|forbidden|unauthorized|bad|gateway|service|internal|access|the page|page|too many|request|server|page)"),
    re.compile(r"\b(?:we(?: are|['’]re) (?:down|offline|closed) for (?:a (?:short |little )?while|maintenance|the moment)|unexpected failure|server (?:met|ran into|encountered|had|has) a(?:n \w+)? ?(?:problem|error|fault|failure)|gave no (?:valid )?reply|timed out before|gateway waited too long|you may not (?:view|access|see|open|read)|forbidden by|(?:go |return )?back to the (?:start|home) ?page|could not find (?:that|the|this) (?:post|page|file|resource|document|article|item)|(?:may|might) have been (?:removed|deleted|moved)|could not connect to)\b"),
    re.compile(r"\bpage (?:you (?:were |are )?(?:looking|searching|asking) for|you (?:requested|want(?:ed)?)|(?:was |could |can ?)?not (?:be )?found|cannot be (?:found|displayed|shown)|does(?: not|n't) exist|no longer exists|is (?:not here|gone|missing|not available|unavailable))\b"),
    re.compile(r"\b(?:not found on this server|nothing (?:is |was )?(?:found )?(?:here|at this (?:address|place|url|link))|the (?:link|address|url) (?:leads nowhere|is broken|is dead|does(?: not|n't) exist|you followed)|nothing (?:was )?found (?:here|at this)|we (?:can't|cannot|couldn't|could not) find (?:the|that|this) page)\b"),
    re.compile(r"\binternal (?:server )?(?:error|fault|failure|problem)\b"),
    re.compile(r"\bservice (?:is )?(?:currently |temporarily )?(?:not available|unavailable|down|out of order|interrupted)\b"),
    re.compile(r"\b(?:maintenance (?:is )?in progress|(?:under|down for|closed for) (?:scheduled |planned )?maintenance|(?:site|page|server) is (?:temporarily |currently )?(?:down|offline|unavailable|overloaded))\b"),
    re.compile(r"\b(?:access (?:is |was |has been )?(?:denied|refused|forbidden|blocked|restricted|rejected)|permission denied)\b"),
    re.compile(r"\byou (?:do not|don't|are not|aren't|have no|lack) (?:have )?(?:the |any )?(?:rights?|permissions?|access|privileges|authori[sz]ed|authori[sz]ation|allowed|permitted)\b.{0,40}\b(?:open|view|access|see|read|resource|page|data|site|area|document|file)\b"),
    re.compile(r"\b(?:something (?:went|has gone) wrong|an (?:unexpected|unknown|internal) (?:error|problem) (?:has )?occurred|oops\b|(?:please )?try (?:it )?again (?:later|in (?:a few|some|\d+)|after|soon))"),
    re.compile(r"\b(?:too many requests|rate limit exceeded|request limit (?:reached|exceeded)|you (?:have been|are) (?:blocked|rate.limited))\b"),
    re.compile(r"\b(?:bad gateway|gateway time.?out|connection (?:timed out|was reset|refused by)|(?:the )?(?:request|server|page) (?:has )?timed out|(?:took|taking) too long to respond|could not connect to the (?:server|database)|error establishing a database connection|your session (?:has )?(?:expired|ended)|session (?:has )?expired)\b"),
    re.compile(r"\b(?:please )?(?:log|sign) in (?:first )?to (?:continue|view|see|read|access|open)\b|\b(?:members|subscribers) only\b|\byou (?:must|need to|have to) (?:log|sign) in\b"),
    re.compile(r"\b(?:página no (?:encontrada|disponible|existe)|vuelv[ae] al inicio|no (?:se (?:ha )?(?:encontró|encontrado|pudo encontrar)|encontramos) (?:la|esta) página|la página (?:solicitada|que busca[s]?)|error interno|fallo interno|acceso (?:denegado|rechazado|prohibido)|servicio no disponible|demasiadas (?:solicitudes|peticiones)|(?:inténtel?[oa]|intente|inténtalo|vuelva a intentarlo|prueb[ae]) (?:de nuevo |otra vez )?(?:más tarde|en unos)|algo (?:salió|ha salido|fue) mal|no tiene[s]? (?:permiso|acceso|derechos?)|sesión ha (?:caducado|expirado)|en mantenimiento)"),
    re.compile(r"\b(?:page (?:non trouvée|introuvable|inexistante)|retour(?:nez)? à (?:l['’]accueil|la page d['’]accueil)|(?:cette|la) page (?:demandée|n['’]existe (?:pas|plus)|que vous cherchez|est introuvable)|erreur interne|accès (?:refusé|interdit|non autorisé)|service (?:indisponible|non disponible)|trop de requêtes|(?:réessayez|veuillez réessayer) (?:plus tard|dans)|une erreur (?:s['’]est produite|est survenue)|vous n['’](?:avez pas|êtes pas) (?:les droits?|le droit|l['’]accès|l['’]autorisation|autorisé)|session a expiré|en (?:cours de )?maintenance)"),
    re.compile(r"\b(?:seite (?:wurde |konnte |ist )?nicht (?:gefunden|verfügbar|vorhanden)|(?:diese|die) seite (?:existiert nicht|gibt es nicht)|zur startseite\b|interner (?:server)?fehler|zugriff (?:verweigert|abgelehnt|gesperrt)|zugang verweigert|dienst (?:ist )?(?:derzeit )?nicht (?:verfügbar|erreichbar)|zu viele anfragen|(?:versuche?(?:n sie)?|probiere?(?:n sie)?) es (?:später|in (?:einigen|wenigen)|bitte)|etwas ist schiefgelaufen|(?:sie haben|du hast) keine (?:berechtigung|rechte|zugriffsrechte)|sitzung ist abgelaufen|wartungsarbeiten)"),
]
SCRIPTS = r"(?:java ?script|scripts?|cookies?|skripte?n?)"
SCRIPT_NOTICE = [
    re.compile(rf"\b(?:enabl\w+|activat\w+|allow\w*|turn(?:ed|ing)? on|switch(?:ed|ing)? on|accept\w*|permit\w*|unblock\w*|requir\w+|needs?|must have|relies on|works? (?:only )?with|does not work without|won't work without|run without)\b.{{0,60}}\b{SCRIPTS}\b"),
    re.compile(rf"\b{SCRIPTS}\b.{{0,60}}\b(?:enabled|activated|allowed|turned on|switched on|required|needed|necessary|disabled|deactivated|blocked|turned off|switched off|not supported|is off|are off|to (?:use|view|see|run|load|continue|display))\b"),
    re.compile(rf"\b(?:browser|page|app|site)\b.{{0,40}}\b(?:does not|doesn't|cannot|can't|do not|don't) (?:run|support|allow|execute|accept|have|load)\b.{{0,30}}\b{SCRIPTS}\b"),
    re.compile(rf"\b(?:habilit\w+|activ\w+|permit\w+|acept\w+|necesit\w+|requier\w+|encend\w+)\b.{{0,60}}\b{SCRIPTS}\b"),
    re.compile(rf"\b(?:activ\w+|autoris\w+|accept\w+|nécessit\w+|requiert|requis\w*|permett\w+)\b.{{0,60}}\b{SCRIPTS}\b"),
    re.compile(rf"\b(?:aktivier\w*|erlaub\w*|akzeptier\w*|benötig\w*|erforder\w*|schalte\w*|lass\w*|zulassen)\b.{{0,60}}\b{SCRIPTS}\b|\b{SCRIPTS}\b.{{0,60}}\b(?:aktivier\w*|ein(?:schalten|geschaltet)?|erlauben|zulassen|akzeptieren|deaktiviert|ausgeschaltet)\b"),
    re.compile(r"\b(?:checking|verifying|we are checking|we're checking) (?:that )?(?:your|the|if the|if your) (?:browser|connection|site connection)\b"),
    re.compile(r"\b(?:verify|confirm|prove|check(?:ing)?)(?:ing)?(?: that| if)? you(?:'re| are) (?:a |not a )?(?:human|robot|real person|bot)\b|\bcomplete the (?:captcha|security check)\b|\b(?:ddos|bot) protection by\b|\bsecurity check\b.{0,40}\bbrowser\b|\byour browser (?:is|was) (?:not supported|out of date|outdated|being checked|too old)\b"),
    re.compile(r"\b(?:comprobando|verificando|estamos (?:comprobando|verificando)) (?:su|tu|el) navegador\b|\b(?:vérification|contrôle|nous vérifions) (?:de )?votre navigateur\b|\b(?:ihr|dein) browser wird (?:gerade )?(?:überprüft|geprüft)\b|\b(?:wir )?(?:überprüfen|prüfen) (?:ihren|deinen) browser\b"),
]

_TAG = re.compile(rf"</?(?:{'|'.join(sorted(HTML_TAGS.split(), key=len, reverse=True))})(?:\s[^<>]*)?/?>", re.I)
_FENCE = re.compile(r"(```|~~~).*?(?:\1|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]{1,200}`")
_HIDDEN = re.compile("[​-‏⁠﻿­]")
_BLANK = re.compile(r"\n\s*\n")
_LEADING = re.compile(r"^(?:#+ |[*>]+ ?)+")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=[^\s])")
_REFERENCE = re.compile(r"\((?:ref|id|code|ray|incident)[^()]{0,40}\)", re.I)
_DIGITS = re.compile(r"[0-9]+")
_DUNDER_NAMES = frozenset(DUNDERS.split())
_TAG_NAMES = frozenset(HTML_TAGS.split())
_LATIN = frozenset(FILLER_LATIN.split())
_LATIN_WORD = re.compile(r"[a-z]+")


def _automaton(literals: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for literal in literals:
        found.add_word(literal, 1)
    found.make_automaton()
    return found


_LATIN_FOUND = _automaton(FILLER_LATIN.split())
# what no match can lack is read off the patterns, so that only patterns are tried that can match
_PLACEHOLDERS, _PAIRED, _UNFILLED = Prefilter(PLACEHOLDERS), Prefilter(PAIRED), Prefilter([UNFILLED, FIELD_UNFILLED])
_TELLING = Prefilter([*FILLER, *SCRIPT_NOTICE, *ERROR])
_KIND_OF = {p: kind for kind, ps in (("filler", FILLER), ("script_notice", SCRIPT_NOTICE), ("error", ERROR)) for p in ps}


def line_key(line: str) -> int:
    """A whole line as it is counted: the signed 64-bit hash of its lower case, with digits as 0 and single spaces; 0 for a blank one."""
    plain = _SPACE.sub(" ", _DIGITS.sub("0", _HIDDEN.sub("", line).lower())).strip()
    return int.from_bytes(xxhash.xxh64_digest(plain), signed=True) if plain else 0


def _twice(pattern: re.Pattern, part: str) -> bool:
    found = pattern.finditer(part)
    return next(found, None) is not None and next(found, None) is not None


def _placeholder(part: str, low: str, english: bool) -> bool:
    if any(p.search(part) for p in _PLACEHOLDERS.may_match(low)):
        return True
    if any(_twice(p, part) for p in _PAIRED.may_match(low)):
        return True
    angles = [m.group(1) for m in ANGLE.finditer(part) if m.group(1).lower() not in _TAG_NAMES]
    if len(angles) > 1 or any(a.isupper() and len(a) > 2 or "_" in a or " " in a for a in angles):
        return True
    names = [m.group(1) for m in DUNDER.finditer(part)]
    if any(n not in _DUNDER_NAMES and (n.isupper() or "_" in n) for n in names) or len([n for n in names if n.lower() not in _DUNDER_NAMES]) > 1:
        return True
    quoted = GUILLEMETS.findall(part)
    if english and len(quoted) > 1 or any(NAME_FORM.fullmatch(q) for q in quoted):
        return True
    return any(len(p.findall(part)) > 1 for p in _UNFILLED.may_match(low))


def _latin(part: str) -> bool:
    latin = sum(w in _LATIN for w in _LATIN_WORD.findall(part))
    return latin > 3 or latin > 1 and len(part) < 40 and part.startswith("lorem")


def _one_word(part: str) -> bool:
    """The same word again and again, with little else."""
    plain = [w for w in (x.strip(".,;:!?") for x in part.split()) if w.isalpha()]
    return len(plain) > 3 and max(Counter(plain).values()) >= 0.7 * len(plain)


def _wordless(part: str) -> bool:
    """Eight or more plain words, no function word of any language, some word twice."""
    plain = part.rstrip(".!?…").split()
    return len(plain) > 7 and ANY_STOPWORD.isdisjoint(plain) and all(map(str.isalpha, (w.rstrip(".,;:!?") for w in plain))) and len(set(plain)) < len(plain)


def _repeats(part: str) -> bool:
    """Some word follows itself or the word after it: all that the patterns without a literal need."""
    words = part.replace(",", " ").split()
    return any(map(eq, words, words[1:])) or any(map(eq, words, words[2:]))


_ENGLISH = frozenset("the is in of and to for with was by are this that you not".split())


def _subtracted(text: str, boilerplate: frozenset[int]) -> str:
    """``text`` without the recurrent lines of its host, if content stands beside them.

    A record of recurrent lines alone is what its host sends instead of
    content, a failed page for one, and is judged as it is.
    """
    lines = text.split("\n")
    own = [line_key(x) not in boilerplate for x in lines]
    if all(own) or not any(o and len(words(x)) >= CONTENT_WORDS for o, x in zip(own, lines, strict=True)):
        return text
    return "\n".join(x for o, x in zip(own, lines, strict=True) if o)


def evidence(text: str | None, boilerplate: frozenset[int] = frozenset()) -> str | None:
    """The first kind of residue in ``text`` less ``boilerplate``, or nothing; null and empty texts hold none."""
    if not text:
        return None
    text = _FENCE.sub("\n\n", _HIDDEN.sub("", text))
    if boilerplate:
        text = _subtracted(text, boilerplate)
    text = _INLINE.sub(" ⌷ ", text)
    for paragraph in _BLANK.split(text):
        lines = [x for x in paragraph.split("\n") if x.strip()]
        if lines and (kind := _kind(" \n ".join(lines))):
            return kind
    return None


def _kind(paragraph: str) -> str | None:
    bare = _REFERENCE.sub(" ", _TAG.sub(" ", paragraph))
    flat = _LEADING.sub("", _SPACE.sub(" ", bare).strip()).rstrip("* ")
    low = flat.lower()
    english = len(_ENGLISH.intersection(low.split())) > 1
    if _placeholder(flat, low, english):
        return "placeholder"
    latin = sum(1 for _ in _LATIN_FOUND.iter(low)) > 1
    for part in _SENTENCE.split(low):
        tried = _TELLING.may_match(part, _repeats(part))
        odd = _wordless(part) or _one_word(part) or latin and _latin(part)
        if not (tried or odd) or NARRATIVE.search(part) or "⌷" in part:
            continue
        if odd:
            return "filler"
        for p in tried:
            if p.search(part):
                return _KIND_OF[p]
    return None


def recurrent_lines(documents: DataFrame, host: str, text: str, share: float, least: int) -> DataFrame:
    """``(host, boilerplate)``: the keys of the lines found in at least ``share`` of a host's records, and in ``least``.

    A host has at most ``1 / share`` times its mean number of lines of them,
    whatever its size. Lines are counted by their hash, first within each
    batch, so neither lines nor a host with most of the corpus are shuffled.
    """
    base = documents.where(F.col(text).isNotNull()).select(F.col(host).cast("string").alias("host"), F.col(text).alias("content"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counted: Counter = Counter()
            for at, content in zip(batch["host"], batch["content"], strict=True):
                counted.update((at, k) for k in set(map(line_key, content.split("\n"))) if k)
            yield pd.DataFrame([(h, k, n) for (h, k), n in counted.items()], columns=["host", "line", "n"])

    lines = spread(base).mapInPandas(count, "host string, line bigint, n bigint")
    counted = lines.groupBy("host", "line").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    totals = broadcast_if_small(base.groupBy("host").agg(F.count("*").alias("total")), "hosts")
    often = counted.join(totals, counted["host"].eqNullSafe(totals["host"])).where(F.col("n") >= share * F.col("total"))
    return often.groupBy(counted["host"].alias("host")).agg(F.collect_list("line").alias("boilerplate"))


def find_residue(
    documents: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", share: float = 0.01, least: int = 20
) -> DataFrame:
    """``(key, kind)`` of the records that hold template residue or a failed page.

    ``kind`` is one of ``KINDS``, the first found. A null host is a host of
    its own. Null, empty and blank texts are no cases; repeated rows give
    repeated result rows; whole texts are read. Other columns are not read.
    """
    often = materialised(recurrent_lines(documents, host, text, share, least), "boilerplate")
    size = often.agg(F.coalesce(F.sum(F.size("boilerplate") * 8 + ROW_BYTES), F.lit(0)).alias("n")).first()["n"]
    often = F.broadcast(often) if size <= BROADCAST_BYTES else often
    # the key passes through Python as text: pandas would turn whole numbers beside nulls into floats
    slim = documents.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias(key), F.col(text).alias("__text"), F.col(host).cast("string").alias("__host"))
    joined = spread(slim).join(often, slim["__host"].eqNullSafe(often["host"]), "left").select(key, "__text", "boilerplate")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, frozenset] = {}
        for batch in batches:
            kinds = []
            for content, lines in zip(batch["__text"], batch["boilerplate"], strict=True):
                at = tuple(lines) if lines is not None else ()
                if at not in known:
                    known[at] = frozenset(at)
                kinds.append(evidence(content, known[at]))
            found = pd.DataFrame({key: batch[key], "kind": kinds})
            yield found[found["kind"].notna()]

    found = joined.mapInPandas(run, f"`{key}` string, kind string")
    return found.select(F.col(key).cast(documents.schema[key].dataType).alias(key), "kind")


def exclude_residue(documents: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``documents`` without the records of :func:`find_residue`; null keys stay."""
    bad = find_residue(documents, key=key, **options).select(key).distinct()
    return documents.join(bad, key, "left_anti")
