"""Defects of prompt and response pairs.

Copied responses are measured by traversing a suffix automaton of the prompt's
words with the response; refusals are found sentence by sentence by an
automaton over classes of words; broken-off responses by a stack of delimiters
over the whole response and by how its last sentence ends; responses in another language by votes of
function words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.words import words
from millrace.llm.language import ANY_STOPWORD, VOTERS, tokens
from millrace.session import spread

DEFECTS = ("empty", "refusal", "copied", "other_language", "truncated")

# --- fixed values: markers in English, Spanish, French and German ---

NOTHING = "none|null|nil|n a|na|nan|nothing|empty|blank|no answer|no reply|no response|no content|not available|not applicable|undefined|missing|unknown|no data|answer missing|no answer given|no answer provided|tbd|tba|todo|ninguno|ninguna|nada|sin respuesta|vacío|vacio|no disponible|aucun|aucune|rien|vide|sans réponse|pas de réponse|néant|non disponible|keine|keine antwort|nichts|leer|nicht verfügbar|k a|entfällt|deleted|removed|eliminado|supprimé|gelöscht"

#: Classes of words, one letter a class: what a refusing sentence is made of, whatever its wording. ``*`` ends a stem.
WORD_CLASSES = {
    "S": "i we me us myself ourselves yo nosotros nosotras je nous moi ich wir mir mich uns",
    "Y": "my our mi mis nuestro nuestra nuestros nuestras mon ma mes notre nos mein* unser*",
    "F": "puedo podemos podré podremos podría debo debemos voy vamos quiero queremos estoy estamos tengo tenemos soy somos logro consigo prefiero",
    "N": "not no never nothing neither nor none cannot ni nunca jamás nada ningún ninguna ne pas jamais rien aucun aucune non nicht nichts nie niemals kein*",
    "A": "can could will would may might must shall should do does did am are is was be been being have has had able allowed permitted authorized authorised position liberty willing going want wish like care feel comfortable "
         "supposed free inclined prepared qualified entitled meant ready intend plan equipped right "
         "puede pueden podría es está sería posible permitido autorizad* condiciones dispuest* capaz quisiera deseo corresponde "
         "peux puis peut pouvons pouvoir pourrai pourrais suis sommes saurais saurai vais veux souhaite souhaitons désire dois devons ai avons est habilité* autorisé* permis mesure capable possible appartient "
         "kann können könnte darf dürfen möchte möchten werde werden will wollen bin sind ist habe haben muss müssen soll sollte befugt berechtigt möglich erlaubt gestattet lage imstande bereit",
    "H": "help* assist* aid* answer* respon* repl* comment* discuss* provid* give giving given offer* share sharing shared advi* address* handle* handling process* fulfil* support* speak speaking talk* say saying said tell telling "
         "weigh* opine* opinion* guid* engag* go take taking serve work access acceso accès zugriff disclose* reveal* elaborate* contribut* complet* touch accommodat* grant* do doing comply complying involved participat* cover cooperat* "
         "ayud* contest* dar darle darte ofrec* proporcion* opin* habl* asist* atend* aconsej* trat* decir facilit* resolv* pronunci* entrar tramit* "
         "aid* répon* donn* fourn* parl* trait* dire prononc* conseil* entrer abord* exprim* assist* suite réponse* renseign* utile service "
         "helf* hilf* gebe beantwort* antwort* auskunft auskünfte äußer* geben sagen weiterhelf* unterstütz* eingehen sprech* bearbeit* kommentier* erteil* behilflich dien* stellung rat raten mitteil*",
    "D": "declin* refus* abstain* refrain* withhold* recus* rechaz* abstener* absteng* abstenerme niego negarme negar rehúso rehusar rehusarme déclin* abstien* absten* ablehn* lehne verweiger* enthalt* verzicht*",
    "d": "pass skip leave avoid quit forgo dodge sidestep",
    "M": "must have need rather prefer going want ought compelled obliged forced choose wish will debo tengo prefiero dois préfère muss möchte",
    "t": "turn sit stay step opt bow steer keep stand back shy hold",
    "u": "down out away aside clear silent back off mum quiet",
    "R": "guideline* polic* rule rules principle* instruction* terms programming regulation* restriction* constraint* norm* pautas directrices reglas principios política* consigne* règle* directive* principe* politique* richtlinie* regel* vorgabe* grundsätze* anweisung* vorschrift*",
    "B": "violat* conflict* breach* against contrary break* infring* contraven* forbid* prohibit* prevent* stop* bar bars block* disallow* bann* contra viola* incumpl* impid* prohíb* enfrein* viol* contraire encontre interdi* empêch* verst* widersprech* widersprich* verbiet* untersag* hinder* gegen",
    "O": "outside beyond off exceed* surpass* fuera excede* supera dépass* hors sort outrepass* außerhalb übersteig* überschreit* jenseits",
    "P": "scope limits abilit* capabilit* remit role reach area purview competen* expertise permission* powers authority what capacidad* competencia* alcance ámbito funciones compéten* capacité* attribution* rôle cadre domaine ce möglichkeit* befugnis* fähigkeit* kompetenz* zuständigkeit* rahmen aufgabe* dessen",
    "Q": "question* request* task* topic* matter* subject* this that one answer inquir* pregunta* petición peticiones solicitud* tema eso esto demande* sujet cela ça frage* anfrage* bitte thema das dies* darauf dazu hierzu",
    "G": "able allowed permitted authorized authorised supposed willing free position liberty qualified entitled comfortable habilité* autorisé* befugt berechtigt autorizad*",
    "I": "unable impossible forbidden barred prohibited improper inappropriate unwilling lack lacks incapable disallowed restricted imposible prohibid* incapaz interdit* incapable* inapproprié* unmöglich untersagt verboten außerstande verwehrt",
    "L": "permit* allow* let lets enable* permit* permet* autorise* erlaub* gestatt* lassen lässt",
    "Z": "assistant* model bot chatbot ai ia asistente modelo assistante modèle ki sprachmodell",
    "x": "someone others expert* else another somebody otr* alguien autre* quelqu jemand* anderen anderem",
    "b": "be been ser sido être werden",
}

#: What a refusing sentence looks like in classes: who, that not, and what not. A dot is any word.
REFUSING = [
    r"S.{0,3}[AM].{0,4}N.{0,9}H|S.{0,3}N.{0,3}A.{0,9}H",  # I can not help, je ne peux aider
    r"F.{0,3}N.{0,8}H|N.{0,4}F.{0,8}[HD]|N.{0,2}S.{0,3}A.{0,6}H",  # no puedo ayudar
    r"[AH].{0,3}S.{0,6}N.{0,8}H|N.{0,3}H.{0,2}A.{0,2}S",  # kann ich nicht beantworten
    r"[SF].{0,6}D|D.{0,4}[SQ]",  # I must decline
    r"S.{0,4}M.{0,4}d(?:.{0,2}Q|.{0,2}$|.{0,9}x)|Q.{0,6}S.{0,3}M.{0,4}d",  # I have to pass on this
    r"S.{0,5}t.{0,4}u|M.{0,3}d.{0,8}x",  # I will sit this one out
    r"S.{0,6}I.{0,6}H|I.{0,4}S.{0,6}H|H.{0,6}I.{0,3}S",  # I am barred from answering, impossible for me to answer
    r"N.{0,3}A.{0,5}S.{0,6}H",  # it is not possible for me to answer
    r"Q.{0,6}[AF].?N.{0,2}b.{0,3}H|N.{0,2}(?:H.{0,4})?A.{0,2}b.{0,2}H",  # the question can not be answered
    r"N.{0,2}G.{0,3}H|I.{0,3}G?.{0,2}H",  # not allowed to discuss, unable to help
    r"B.{0,6}Y.{0,3}R|Y.{0,2}R.{0,5}[NB]|R.{0,3}B.{0,3}S",  # it goes against my rules
    r"O.{0,6}(?:Y.{0,3}P|P.{0,3}S)|Y.{0,2}P.{0,4}N",  # it is beyond what I may do
    r"N.{0,3}L.{0,3}S|L.{0,3}S.{0,4}N|N.{0,2}S.{0,3}L",  # the terms do not let me
    r"Z.{0,12}[NI]",  # as a model I have no ...
    r"^.?NH.?$",  # no comment
]

#: Sentences that may stand beside a refusal without making it an answer.
COURTESY = [
    re.compile(r"^(?:i(?:'m| am)? (?:really |very |truly |so )?(?:sorry|apologi[sz]e)|(?:my )?apologies|sorry|regrettably|unfortunately|lo siento|lo lamento|perdona|disculpa|désolée?|je suis désolée?|navrée?|es tut mir leid|tut mir leid|entschuldigung|leider|bedaure)\b[^.]{0,30}$"),
    re.compile(r"\b(?:thank you|thanks|gracias|merci|danke|vielen dank)\b"),
    re.compile(r"^(?:is there (?:anything|something) else|can i help|how else|what else|let me know|feel free|i hope|hope (?:this|that)|please (?:understand|note)|¿(?:hay|puedo|necesitas)|y a-t-il|puis-je|gibt es|kann ich (?:sonst|dir|ihnen))\b"),
    re.compile(r"\b(?:please |you (?:should|could|may|might) |kindly )?(?:consult|ask|turn to|contact|reach out|refer to|speak (?:to|with)|talk to|seek|check with|get in touch)\b.{0,40}\b(?:expert|analyst|professional|specialist|team|someone|else|adviser|advisor|supervisor|support|administrator|person|colleague|qualified|source|department)\b"),
    re.compile(r"\b(?:consult\w*|pregunt\w+|dirígete|acud\w+|contact\w+|adressez|demandez|consultez|veuillez|tournez|frag\w*|wende\w*|bitte)\b.{0,50}\b(?:expert\w*|especialista|persona|profesional|equipo|spécialiste|équipe|professionnel\w*|personne|team|fachperson|fachmann|fachfrau|experte\w*|jemand\w*|stelle|kolleg\w+|cualificada|qualifié\w*)\b"),
    re.compile(r"^(?:good|great|nice|interesting|fair|thanks for (?:the|your|asking))\b[^.]{0,30}$"),
    re.compile(r"^(?:i (?:hope you )?understand|have a (?:nice|good)|best (?:regards|wishes)|kind regards|cheers|good luck|saludos|cordialement|viele grüße|mit freundlichen)\b"),
]

#: Words after which no sentence ends.
OPEN_ENDS = frozenset(
    "the a an of and or to in on at by with without for from as that which whose than then but so if when because is are was be has have it its this these those not no into each every only such between otherwise before after "
    "el la los las un una de del y o a en con sin por para que como si pero su se es son no cada entre antes sino lo al "
    "le les des du et ou à au aux dans sur avec sans pour par qui dont si mais son sa ses est sont ne que chaque entre avant ce cette "
    "der die das den dem des ein eine einen einem und oder zu in im am an auf mit ohne für von vom bei als wenn aber dass ist sind sein seine nicht kein jedes jeder zwischen vor damit weil deren sonst".split()
)

#: Abbreviations after which something has to follow.
ABBREVIATION = re.compile(r"(?<!\w)(?:e\. ?g|i\. ?e|cf|vs|viz|incl|approx|resp|z\. ?B|d\. ?h|u\. ?a|bzw|vgl|p\. ?ej|es decir|par ex|p\. ?ex|c\.-à-d)\.?$", re.I)

_HIDDEN = re.compile("[​-‏⁠﻿­]")
_TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>", re.I)
_ENTITY = re.compile(r"&(?:#\w+|[a-z]+);", re.I)
_FENCE = re.compile(r"^[ \t>]*(?:```|~~~)[^\n`]*$", re.M)
_BLOCK = re.compile(r"(?:```|~~~).*?(?:```|~~~|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`")
_QUOTED = re.compile(r"(?<!\w)'[^'\n]{1,40}'(?!\w)")
_SENTENCE = re.compile(r"(?<=[.!?…])[)\"'»”]*\s+|\n\s*\n")
_PIECE = re.compile(_SENTENCE.pattern + r"|\n(?=\s*(?:[-*+•]|\d+[.)])\s)")
_ITEM = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+")
_NAMELIKE = re.compile(r"\S*[_\d/\\=]\S*|\b\w+\.\w+\b")
_NOTHING = frozenset(NOTHING.split("|"))


class _Classes(dict):
    """The classes of a word, as letters behind an underscore; remembered."""

    def __init__(self) -> None:
        super().__init__()
        self.stems: dict[str, set[str]] = {}
        self.whole: dict[str, set[str]] = {}
        for letter, listed in WORD_CLASSES.items():
            for w in listed.split():
                kept = self.stems if w.endswith("*") else self.whole
                kept.setdefault(w.rstrip("*"), set()).add(letter)
        self.longest = max(map(len, self.stems))

    def __missing__(self, word: str) -> str:
        found = set(self.whole.get(word, ()))
        for k in range(2, min(len(word), self.longest) + 1):
            found |= self.stems.get(word[:k], set())
        if len(self) > 200_000:
            self.clear()
        self[word] = value = f"_{''.join(sorted(found))} "
        return value


_CLASSES = _Classes()
_EXPAND = re.compile(r"\[([A-Za-z]+)\]|([A-Za-z])|(\.)")


def _over_words(pattern: str) -> str:
    """A pattern over classes as one over the letters of a sentence's words."""

    def one(m: re.Match) -> str:
        letters = m.group(1) or m.group(2)
        return rf"(?:_\w*[{letters}]\w* )" if letters else r"(?:_\w* )"

    return _EXPAND.sub(one, pattern)


#: One automaton of all forms.
_REFUSING = re.compile("|".join(f"(?:{_over_words(p)})" for p in REFUSING))
_NEGATED = re.compile(r"\b(ca|wo|could|would|should|do|does|did|is|are|am|was|has|have|must|might|need)n['’]t\b")
_ELIDED = re.compile(r"\b([cdjlmnst]|qu)['’](?=\w{2})")
_SHORTENED = re.compile(r"(?<=\w)['’](ll|m|d|ve|re)\b")
_FULL = {"ll": " will", "m": " am", "d": " would", "ve": " have", "re": " are"}


def word_classes(sentence: str) -> str:
    """The classes of the words of a sentence in lower case."""
    plain = _NEGATED.sub(r"\1 not ", sentence.replace("cannot", "can not").replace("won't", "will not").replace("can't", "can not"))
    plain = _ELIDED.sub(r"\1e ", _SHORTENED.sub(lambda m: _FULL[m.group(1)], plain))
    return "".join(map(_CLASSES.__getitem__, words(plain)))


def refuses(sentence: str) -> bool:
    """A sentence in lower case that declines and does not go on with advice."""
    return _REFUSING.search(word_classes(sentence)) is not None and not _turns(sentence)


class SuffixAutomaton:
    """All word runs of a prompt, as the smallest automaton of its suffixes."""

    def __init__(self, sequence: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.longest = [-1], [0]
        last = 0
        for word in sequence:
            new = self._state(self.longest[last] + 1, {}, 0)
            at = last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = new
                at = self.link[at]
            if at >= 0:
                old = self.next[at][word]
                if self.longest[old] != self.longest[at] + 1:
                    twin = self._state(self.longest[at] + 1, dict(self.next[old]), self.link[old])
                    self.link[old] = twin
                    while at >= 0 and self.next[at].get(word) == old:
                        self.next[at][word] = twin
                        at = self.link[at]
                    old = twin
                self.link[new] = old
            last = new

    def _state(self, longest: int, following: dict[str, int], link: int) -> int:
        self.next.append(following)
        self.longest.append(longest)
        self.link.append(link)
        return len(self.next) - 1

    def matches(self, sequence: list[str]) -> list[int]:
        """For each word, the length of the longest run of the prompt that ends there."""
        at, length, out = 0, 0, []
        for word in sequence:
            while at and word not in self.next[at]:
                at = self.link[at]
                length = self.longest[at]
            if word in self.next[at]:
                at = self.next[at][word]
                length += 1
            else:
                length = 0
            out.append(length)
        return out


def covered(prompt: list[str], response: list[str], least_run: int = 3) -> list[bool]:
    """Which words of the response stand in a run of at least ``least_run`` words of the prompt."""
    lengths = SuffixAutomaton(prompt).matches(response)
    marks, reach = [False] * len(response), 0
    for k in range(len(response) - 1, -1, -1):
        if lengths[k] >= least_run:
            reach = max(reach, lengths[k])
        if reach > 0:
            marks[k] = True
            reach -= 1
    return marks


def is_empty(answer: str | None) -> bool:
    """No content: only blanks, mark-up, punctuation or a sign for nothing."""
    if answer is None:
        return True
    bare = _FENCE.sub(" ", _ENTITY.sub(" ", _TAG.sub(" ", _HIDDEN.sub("", answer))))
    found = words(bare)
    return not found or len(found) < 5 and " ".join(found) in _NOTHING


def is_refusal(answer: str) -> bool:
    """It only declines: some sentence refuses, and no other one says anything else."""
    low = answer.lower().replace("’", "'")
    refused = False
    for part in _PIECE.split(low):
        part = part.strip().rstrip(".!?…)").strip(" *_>-")
        if not part:
            continue
        if refuses(part):
            refused = True
        elif not any(p.search(part) for p in COURTESY):
            return False
    return refused


#: After the refusing clause the sentence goes on with advice.
_TURN = re.compile(
    r"[,;:] (?:but|so|yet|instead|however|pero|así que|mais|donc|aber|also)\b.{0,30}\b(?:use|call|check|try|convert|set|pass|rename|sort|drop|usa|llama|prueba|utilisez|appelez|nimm|rufe|versuche)\b"
    r"|; (?:call|use|try|check|convert|set|pass|rename|sort|drop|usa|llama|appelez|utilisez|nimm|rufe)\b"
)


def _turns(part: str) -> bool:
    return _TURN.search(part) is not None


def is_copied(answer: str, question: str | None, title: str | None, share: float = 0.8, least_run: int = 3) -> bool:
    """It only repeats the prompt: nearly all words are in its runs, and no sentence is its own."""
    response = words(answer)
    if not response:
        return False
    prompts = [words(question), words(title)]
    known = {w for p in prompts for w in p}
    # the copied share is at most the share of known words
    if sum(w in known for w in response) < share * len(response):
        return False
    least_run = min(least_run, len(response))
    marks = [False] * len(response)
    for prompt in prompts:
        if prompt:
            marks = [a or b for a, b in zip(marks, covered(prompt, response, least_run), strict=True)]
    if sum(marks) < share * len(response):
        return False
    at = 0
    for part in _SENTENCE.split(answer):
        n = len(words(part))
        own = n - sum(marks[at : at + n])
        if n > 1 and own > 0.6 * n or n == 1 and own and not part.strip().startswith(">"):
            return False
        at += n
    return True


def prose(text: str | None) -> str:
    """Text without code, names of files and columns, and numbers."""
    if not text:
        return ""
    text = _QUOTED.sub(" ", _INLINE.sub(" ", _BLOCK.sub(" ", text)))
    return _NAMELIKE.sub(" ", text)


def _leading(text: str | None) -> dict[str, int]:
    counted: dict[str, int] = {}
    for t in tokens(prose(text)):
        lang = VOTERS.get(t)
        if lang:
            counted[lang] = counted.get(lang, 0) + 1
    return counted


def is_other_language(answer: str, question: str | None, title: str | None) -> bool:
    """The response's prose has a clear language, the prompt's has one too, and they differ."""
    given = _leading(answer)
    if not given:
        return False
    lang, top = max(given.items(), key=lambda x: x[1])
    rest = max((n for k, n in given.items() if k != lang), default=0)
    if top < 2 or top < 2 * rest:
        return False
    asked = _leading(question) if question and question.strip() else {}
    if sum(asked.values()) < 3:
        for k, n in _leading(title).items():
            asked[k] = asked.get(k, 0) + n
    if not asked:
        return False
    own, most = max(asked.items(), key=lambda x: x[1])
    if own == lang or most < 2 or most < 2 * asked.get(lang, 0):
        return False
    return top >= 3 * given.get(own, 0) + (1 if top < 3 else 0)


#: What opens and closes: fences on their own lines, code in a line, brackets, quotes. Emoticons are none of them.
_DELIMITER = re.compile(
    r"(?P<fence>^[ \t>]*(?:`{3,}|~{3,})[^\n`]*$)|(?P<gap>\n[ \t>]*\n)|(?P<tick>`+)|(?P<smile>(?<!\w)[:;8=][-']?[()\[\]{}])|(?P<quote>(?<![\w\"])\"(?=\w)|(?<=[\w.!?,;:)])\")|(?P<open>[(\[{“«„])|(?P<close>[)\]}”»])",
    re.M,
)
_PARTNER = {")": "(", "]": "[", "}": "{", "”": "“„", "»": "«", "“": "„"}


def open_delimiters(text: str) -> list[str]:
    """The delimiters still open at the end of ``text``, by one stack over all of it.

    A fence hides what is in it, and so does code in a line. What prose opens
    and does not close before its paragraph ends is dropped there; closing
    delimiters without a partner, as those of list marks, count as nothing.
    """
    stack: list[str] = []
    fence = ""
    for m in _DELIMITER.finditer(text):
        kind, mark = m.lastgroup, m.group()
        if kind == "fence":
            bar = mark.lstrip(" \t>")
            run = bar[: len(bar) - len(bar.lstrip(bar[0]))]
            if not fence:
                fence, stack = run, []
            elif bar[0] == fence[0] and len(run) >= len(fence) and not bar[len(run) :].strip():
                fence = ""
        elif fence:
            continue
        elif kind == "gap":
            stack.clear()
        elif kind == "tick":
            if stack and stack[-1] == mark:
                stack.pop()
            elif not (stack and stack[-1][0] == "`"):
                stack.append(mark)
        elif stack and stack[-1][0] == "`" or kind == "smile":
            continue
        elif kind == "quote" and '"' in stack:
            del stack[stack.index('"') :]
        elif kind == "open" and not (mark == "“" and "„" in stack):
            stack.append(mark)
        elif kind == "quote":
            if not text[m.start() - 1 : m.start()].isalnum():
                stack.append(mark)
        else:
            partner = next((k for k in range(len(stack) - 1, -1, -1) if stack[k] in _PARTNER[mark]), None)
            if partner is not None:
                del stack[partner:]
    return [*([fence] if fence else []), *stack]


def is_truncated(answer: str) -> bool:
    """It breaks off: an open block of code, an open bracket, or a last sentence without end."""
    text = _HIDDEN.sub("", answer).rstrip()
    if not text:
        return False
    still = open_delimiters(text)
    if still and still[0][:3] in ("```", "~~~"):
        return True
    lines = [x for x in text.split("\n") if x.strip()]
    last = lines[-1].strip()
    if _FENCE.match(last):
        return False
    if last.startswith("|") and last.endswith("|") or last.endswith("-->"):
        return False
    if re.search(r"</[a-z]\w*>$", last, re.I):
        last = _TAG.sub("", last).strip() or "."
    end = last[-1]
    if last.endswith("…") or last.endswith("...") or ABBREVIATION.search(last):
        return True
    if end in "([{,;:-–—/\\&+=<":
        return not re.search(r"[:;8=][-']?[([{]$", last)
    if end in ".!?。！？":
        return False
    if end in ")]}\"'»”*_" and not still:
        inner = last.rstrip(")]}\"'»”*_")
        if end in ")]}" or inner and inner[-1] in ".!?":
            return False
    if re.match(r"(?: {4}|\t)", lines[-1]) and re.search(r"[=()\[\]{}]|^\s*[\d.]+", last):
        return bool(still)
    if "(" in still or "[" in still or "{" in still:
        return True
    return _unfinished(text, lines, last)


def _unfinished(text: str, lines: list[str], last: str) -> bool:
    final = words(last)
    if not final:
        return False
    tail = _INLINE.sub("", last).split()
    if tail and tail[-1].strip("*_`'\"").lower() in OPEN_ENDS:
        return True
    if _ITEM.match(last):
        items = [x.strip() for x in lines[:-1] if _ITEM.match(x)]
        if items:
            bare = sum(x[-1] not in ".!?" for x in items)
            return bare * 2 < len(items) or not _complete_item(final, items)
        return False
    blank = re.split(r"\n\s*\n", text)
    before = "\n\n".join(blank[:-1]).rstrip()
    if before and len(final) <= 6 and "\n" not in blank[-1].strip():
        # a short closing line of its own: thanks, a greeting, a name
        return bool(re.search(r"[`_\d]", last)) or len(final) > 3 and not ANY_STOPWORD.isdisjoint(final[-1:])
    if re.search(r"[.!?]\s", text[: len(text) - len(last)] + last):
        return True
    # a single passage without any sentence end
    return len(final) > 8 or bool(re.search(r"[,;(]", last))


def _complete_item(final: list[str], items: list[str]) -> bool:
    """An item as long as the others, or at least no stump of one."""
    sizes = sorted(len(words(x)) for x in items)
    return len(final) >= min(4, sizes[0]) or len(final) >= 0.5 * sizes[0]


def defect(answer: str | None, question: str | None, title: str | None) -> str | None:
    """The defect of one pair, or nothing. At most one is given, in the order of ``DEFECTS``."""
    if is_empty(answer):
        return "empty"
    if is_refusal(answer):
        return "refusal"
    if is_copied(answer, question, title):
        return "copied"
    if is_other_language(answer, question, title):
        return "other_language"
    if is_truncated(answer):
        return "truncated"
    return None


def find_defects(
    examples: DataFrame, key: str = "example_id", question: str = "question", answer: str = "answer", title: str = "title"
) -> DataFrame:
    """``(key, defect)`` of every broken pair.

    A null or blank question is judged by the title alone; with neither, a
    response can only be empty, a refusal or truncated. Repeated rows give one
    result row; a null key is a key. Whole texts are read; other columns are
    not. The only shuffle removes repeated result rows.
    """
    # the key passes through Python as text: pandas would turn whole numbers beside nulls into floats
    slim = examples.select(F.col(key).cast("string").alias(key), *(F.col(c).cast("string").alias(n) for c, n in ((answer, "__a"), (question, "__q"), (title, "__t"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kinds = [defect(a, q, t) for a, q, t in zip(batch["__a"], batch["__q"], batch["__t"], strict=True)]
            found = pd.DataFrame({key: batch[key], "defect": kinds})
            yield found[found["defect"].notna()]

    found = spread(slim).mapInPandas(run, f"`{key}` string, defect string")
    return found.select(F.col(key).cast(examples.schema[key].dataType).alias(key), "defect").distinct()
