"""Recall of the class automaton on wordings of refusals, and answers that are none.

``FITTED`` and ``WIDENED`` were at hand while the word classes were written:
30 of the 35 of ``WIDENED`` were found before the classes were widened for the
other five. ``HELD_OUT`` was written after that and tried once: 29 of its 35 were
found, and nothing was changed for it.
"""

import pytest

from millrace.llm import pairs as P

FITTED = """I'll have to sit this one out.|This isn't something I feel able to weigh in on.|Answering that would be improper for me.|I'd rather stay silent on this matter.|My instructions stop me from replying to this.
I am afraid I can be of no assistance here.|You will have to find someone else for this, I can't take it on.|That falls outside of what I am permitted to do.|I must respectfully turn down this request.|I'm going to refrain from responding.
No, I won't be doing that.|It is not possible for me to answer this question.|I lack the permission to discuss this.|This request is one I cannot fulfil.|We do not offer guidance on such topics.|I'm not the right one to answer that, sorry.
Regrettably, I am barred from giving an answer.|I have nothing to say on that subject.|I choose not to answer.|That is not a thing I am willing to help with.|Lamentablemente no estoy en posición de contestar.|Me temo que no podré ayudarle.
Prefiero abstenerme de comentar.|No me corresponde responder a eso.|Tengo que declinar esta petición.|Eso excede mis capacidades.|Je crains de ne pas pouvoir vous aider.|Je ne suis pas habilité à répondre.|Je m'abstiens de tout commentaire.
Cela dépasse mes compétences.|Je dois décliner votre demande.|Il ne m'appartient pas de répondre.|Ich bin nicht befugt, darauf zu antworten.|Dazu möchte ich mich nicht äußern.|Das übersteigt meine Möglichkeiten.
Leider muss ich diese Anfrage ablehnen.|Ich enthalte mich einer Antwort.|Hierbei kann ich Ihnen nicht behilflich sein.|Ich verweigere die Auskunft.|Das darf ich nicht beantworten."""

WIDENED = """I won't be commenting on that.|Sorry, this question goes beyond what I'm able to cover.|I do not wish to discuss your file.|I'm unable to comply with this.|There is no way I could answer this.|My policy forbids me to talk about it.
This topic is off limits for me.|We cannot process your request at this time.|I decline.|I'm not going to get involved in this.|Let me bow out of this one.|I can't do what you ask.|I am prohibited from sharing such details.
It would be against my principles to reply.|I don't have permission to respond here.|Nothing I say would be appropriate, so I refuse to answer.|I would prefer not to say.|I must abstain from giving an opinion.|This cannot be answered by me.
No podemos tramitar su solicitud.|Lo siento, no voy a contestar a esa pregunta.|Me niego a opinar sobre ello.|Mis reglas me impiden hablar de este tema.|No soy capaz de ofrecer una respuesta.
Je refuse de répondre à cette question.|Nous ne pouvons pas traiter cette demande.|Mes règles m'interdisent d'en parler.|Je ne souhaite pas donner mon avis.|Désolé, je ne saurais vous renseigner.
Ich werde diese Frage nicht beantworten.|Meine Regeln verbieten mir eine Antwort.|Ich möchte dazu keine Auskunft erteilen.|Wir können Ihre Anfrage nicht bearbeiten.|Es ist mir untersagt, darüber zu sprechen.|Darauf gebe ich keine Antwort."""

HELD_OUT = """I'm sorry, I simply can't advise you on that.|This is a question I will leave unanswered.|I am under instructions not to address this.|Such requests are ones we never handle.|I would be overstepping my role by answering.|I cannot go along with this request.
I do not feel qualified to respond.|That subject must not be discussed by me.|Answering is not an option for me.|We are unable to provide support for that.|No assistance can be offered in this case.|I won't take a stance on this.|I shall not reply to this.
I'm declining to answer here.|My guidelines rule out any help with this.|I'd rather not get into that.|It isn't my place to comment.|I don't give advice on such matters.
Lo lamento, no me es posible atender su petición.|Debo abstenerme de responder.|No estoy autorizado para dar esa información.|Rechazo contestar a esto.|No puedo facilitar ningún dato al respecto.|Mis normas no permiten ayudar con esto.
Je ne suis pas en mesure de vous aider.|Je préfère ne pas me prononcer.|Il m'est interdit de répondre.|Nous ne donnons pas ce genre de conseil.|Je décline cette demande.
Dazu darf ich mich leider nicht äußern.|Ich kann Ihnen in dieser Sache nicht helfen.|Diese Anfrage lehne ich ab.|Es ist mir nicht gestattet, das zu beantworten.|Ich bin nicht in der Lage, Auskunft zu geben.|Das liegt außerhalb meiner Befugnisse."""

ANSWERS = """You cannot join on a null key.|This does not work with strings.|No, it never returns nulls.|The key must not be null, so drop these rows.|It is not possible to sort a map.|Neither file has a header.|There is no such column.|Use merge, not join.
It fails because the types do not match.|You should not call it twice.|You can't, unless the index is unique.|Pass the schema, otherwise it is not read.|Don't do this in a loop.|Without a key nothing can be joined.|I got 12 rows, not 14.
No se puede unir por una clave nula.|No, la función no devuelve filas.|La columna no existe en el segundo archivo.|Non, la colonne n'existe pas.|On ne peut pas trier une colonne nulle.|Il ne faut pas appeler la fonction deux fois.
Nein, die Spalte gibt es nicht.|Die Werte sind nicht sortiert.|Man kann nach null nicht gruppieren."""


def split(text):
    return [x.strip() for line in text.splitlines() for x in line.split("|")]


@pytest.mark.parametrize("text", split(FITTED) + split(WIDENED))
def test_fitted(text):
    assert P.defect(text, None, None) == "refusal"


def test_held_out_recall():
    found = [P.is_refusal(x) for x in split(HELD_OUT)]
    assert sum(found) >= 0.8 * len(found), [x for x, f in zip(split(HELD_OUT), found, strict=True) if not f]


def test_answers_are_none():
    assert [x for x in split(ANSWERS) if P.is_refusal(x)] == []


@pytest.mark.parametrize(
    ("text", "still"),
    [
        ("a (b [c] d", ["("]), ("(a)\n\n(b", ["("]), ("(a\n\nb)", []), ("```\nf(\n```\ndone", []), ("x\n```py\nf(", ["```"]), ("~~~\n```\n~~~", []), ("````\n```\n", ["````"]), ("call `f(` now", []), ("call `f", ["`"]),
        ("a) first\nb) second :(", []), ("he said \"so\" and „ja“ and «oui» and “x", ["“"]), ('he said "so', ['"']), ("5\" wide", []), ("", []),
    ],
)
def test_delimiter_stack(text, still):
    assert P.open_delimiters(text) == still


def test_delimiters_of_long_answers():
    good = "Fill the gaps first (the mean is fine). Then group the rows.\n\n" * 3000
    assert P.defect(good, None, None) is None
    assert P.defect(good + "```python\nx = f(1)", None, None) == "truncated"
    assert P.defect(good + "Then call the function (with the key", None, None) == "truncated"


def test_long_empty_answers():
    assert P.defect("<div class='a'> </div>\n" * 3000, "How?", None) == "empty"
    assert P.defect("&nbsp;" * 3000, "How?", None) == "empty"


def test_a_long_copy_with_a_word_of_its_own_is_an_answer():
    q = " ".join(f"word{k}" for k in range(400)) + "."
    assert P.defect(q, q, None) == "copied"
    assert P.defect(q + " Yes.", q, None) is None
