"""Generated language: fact sentences, greetings, turn makers, question paraphrases and rough typing.

Pools are data; each generator is one expression, stated once for both engines (see functions.dialect).
All draws are keyed, so any partitioning gives the same text.
"""

from __future__ import annotations

from turnloom.functions.dialect import Dialect, quoted
from turnloom.functions.inflect import BASE_RULES, ING_RULES, PAIRED, UNCOUNTED, inflected_word

#: Things and what is said of them; "is ..." names them, other predicates start with a verb.
FACTS = {
    "abacus": "counts with beads on wires", "awning": "keeps the sun off a shop front", "beacon": "warns ships at night", "bobbin": "holds thread for sewing", "corkscrew": "pulls a stopper from a bottle",
    "crowbar": "levers boards apart", "drizzle": "is rain too fine to hear", "easel": "props up a canvas", "fjord": "is a sea valley between cliffs", "glacier": "is ice that creeps downhill",
    "honey": "is what bees put by for winter", "lagoon": "is calm water behind a reef", "metronome": "beats time for a player", "oar": "pushes a boat along", "quill": "writes with ink and a feather",
    "saddle": "seats a rider", "scissors": "cut cloth along a line", "trellis": "carries plants that climb", "turnstile": "lets people pass one by one", "tweezers": "pick up what is tiny",
    "umbrella": "turns rain aside", "whetstone": "sharpens a dull blade",
}
SAYING = ["Put simply, {np} {pred}.", "As a rule {it} {pred}.", "{NP} {pred}, day in, day out.", "Ask anyone: {np} {pred}."]
USING = ["People reach for {np} to {base}.", "Made well, {np} can {base}.", "Who would {base} without {np}?"]
DOING = ["{Ing} takes {np}.", "When it comes to {ing}, try {np}.", "{NP} and {ing} belong together."]
NAMING = ["By {np} people mean {noun}.", "{NP}, in other words, {is} {noun}.", "Picture {noun}: that {is} {np}."]
REMARKS = ["No more to it.", "So I have read.", "Few people think about it.", "It took a while to get right.", "That has not changed for ages."]
SALUTES = ["Hello", "Good day", "Welcome", "Greetings", "Glad you came", "Nice to see you", "Well met", "Hello there", "A fine day to you", "Come in", "You found me", "Pleased to meet you", "Hello again, or for once", "Ah, a reader"]
NOTES = ["I am a short program", "I read letter by letter", "I need no network", "I learned from small talk", "I know a handful of facts", "I like brief questions", "I fit on a floppy", "I was written in a week of rain", "I run where you are", "I keep no diary", "I can add two numbers", "I have never seen a harbour", "I was taught by one person", "I forget you when you leave"]
PROMPTS = ["What brings you here?", "Which thing shall I explain?", "Name a subject.", "What should we look at?", "Pick anything you like.", "How may I help?", "Where shall we begin?", "Say a word, and I will try.", "Have you a sum for me?", "Tell me what you wonder about.", "Is there a thing you never understood?", "Begin wherever you please.", "What is on your desk today?", "Shall we take turns?"]
HEDGES = ["I do slip up.", "I keep it brief.", "Please check my sums.", "My memory is short.", "Long words trip me.", "Some answers will be wrong.", "I know less than it seems.", "Be patient with me.", "I may say a thing twice.", "Doubt me now and then."]
WHOLE_GREETINGS = ["Hello. The page was blank until now.", "Welcome. I start from nothing each time.", "Good day. There is only you and me here.", "Greetings from a very small file."]
SOCIAL = {
    "greet": (["hello", "hi", "hey there", "good morning"], ["Hello to you.", "Hi. Good to hear from you.", "Good day."]),
    "thank": (["thanks", "thank you", "much obliged"], ["You are welcome.", "Any time.", "Glad it helped."]),
    "ack": (["ok", "I see", "right then", "fair enough"], ["Good.", "Anything else?", "I am here if you need more."]),
    "bye": (["bye", "see you", "good night"], ["Goodbye.", "Until next time.", "Take care."]),
}
SOCIAL_WEIGHTS = [40, 20, 25, 15]
#: What may follow a courtesy.
SOCIAL_MORE = {
    "greet": ["What shall we talk about?", "I was just sitting idle.", "You are the first today.", "Ask me something.", "How is the day treating you?", "It was quiet here.", "Pull up a chair.", "I have all afternoon."],
    "thank": ["Come back with the next one.", "It was a small thing.", "I enjoy such questions.", "That one I knew.", "Shall we do another?", "Now I am curious what follows."],
    "ack": ["We can stay with it.", "Or shall we change the subject?", "Take your time.", "I can put it another way.", "The rest is easier.", "Tell me if it helps."],
    "bye": ["It was pleasant.", "The door stays open.", "I will not remember this, sadly.", "Mind the step.", "Greet the others.", "Sleep on it."],
}
#: Turns of a dialogue that stays with its subject: openings, questions after one or several things, courtesies, changes of the subject, and what is said without one.
OPENINGS = ["Tell me about {np}.", "What of {np}?", "I saw {np} yesterday.", "Do you know {np}?"]
AFTER = {False: ["And what else about it?", "Why is it so?", "What is it good for?", "Say more of it."], True: ["And what else about them?", "Why are they so?", "What are they good for?", "Say more of them."]}
CHANGES = ["Let us talk of something else.", "Enough of that.", "Another matter, please."]
CHANGED = ["Gladly. What shall it be?", "As you like.", "Then I let it rest."]
ASIDE, ASIDE_REPLIES = ["I see.", "Ha.", "Good.", "Hm."], ["Yes.", "Just so.", "Quite."]
NOTHING_YET = ["Of what, if I may ask?", "We have no subject yet.", "Name one, and I will try."]
#: Kinds of exchange within a conversation, by weight (the social kind stands at its edges only).
KINDS = {"known": 34, "unknown": 16, "clarify": 10, "chit": 14, "cannot": 16}
QUESTIONS = ["What does {name} mean?", "Could you explain {name}?", "I keep hearing of {name}. What is meant?", "{name}, please."]
MADE_UP = (["zor", "plim", "quad", "vesk", "tarn"], ["bit", "nock", "gle", "fer", "dax"])
MADE_UP_QUESTIONS = ["What does {name} mean?", "Have you come across a {name}?", "Explain {name} to me."]
IGNORANCE = ["That word is new to me.", "I was never told about it.", "I would have to make that up.", "It is in none of my texts."]
VAGUE = ["Something about {name}?", "{name}. The other thing.", "Is it like {name}?"]
ASK_BACK = ["Do you mean what {name} can do?", "Which side of {name} do you have in mind?", "Could you say a little more?"]
CHIT = [
    ("Do you ever sleep?", ["Between your lines, in a way.", "Only when nobody types."]), ("Are you clever?", ["In a narrow way.", "Less than I sound."]), ("Tell me a joke.", ["I am one already.", "My sums are the joke."]),
    ("What do you like?", ["Short words.", "A plain question."]), ("Are we friends?", ["For as long as the page is open.", "I would say so."]),
]
#: Questions beyond reach, and what they are about.
BEYOND = {"What will I eat tonight?": "your supper", "Which train is late?": "the trains", "How warm is it outside?": "the weather", "Where did I leave my keys?": "your keys", "What did the papers write?": "the news"}
NO_ACCESS = ["I only see this page.", "Nothing outside reaches me.", "That I cannot look up.", "You would know better than I."]
MORE = ["And what else?", "Go on.", "Is there more to it?", "Why so?"]
MORE_REPLIES = ["That is about all.", "Not much, I fear.", "The rest is detail."]
THOUGHTS = {
    "known": "They ask about {name}. I know a line on it.", "unknown": "{name} is no word of mine. Say so.", "clarify": "Too vague. Ask back about {name}.", "chit": "Small talk. Stay light.",
    "cannot": "Out of my reach. Be plain about it.", "social": "A courtesy. Return it.", "more": "Still about {name}. Add little.",
}

#: Parts of sentences about the world: nouns and adjectives (with their article by rule), verbs, places, times, causes.
NOUNS, QUALITIES = ["heron", "orchid", "engine", "island", "melody", "stone wall", "owl", "barge"], ["idle", "slender", "amber", "uneven", "patient", "hollow"]
VERBS, WHERE = ["drifts", "hums", "waits", "leans", "settles", "turns"], ["by the ford", "under the eaves", "past the mill", "along the quay"]
WHEN, CAUSES = ["at dusk", "after rain", "in early spring", "before noon"], ["the light is low then", "nothing hurries it", "it has always been so", "the ground gives way"]
STATEMENTS = [
    "{A} {n} {v} {w}.", "{T}, {a} {n} {v} {w}.", "{A} {n} {v} because {c}.", "Look {w}: {a} {n} {v}.", "{T} one sees how {a} {n} {v}.", "Since {c}, {a} {n} {v} {t}.", "{A} {n} {v}; {c}.",
    "Nobody minds that {a} {n} {v} {w}.", "{A} {n} and {m} share a habit: {c}.", "It is {t} that {a} {n} {v}.",
]
ASKED = ["Did you see {a} {n} {w}?", "Where would {a} {n} go {t}?", "Why should {a} {n} {b}?", "Is there {m} {w}?", "Which is rarer, {m} or {a} {n}?", "Does {m} {b} {t}?", "Who keeps {a} {n} {w}?"]
OPINIONS = ["I would trade much for {a} {n}.", "{M} {t} beats any other, I find.", "To me {a} {n} is worth the walk {w}.", "I doubt that {m} can {b}.", "I side with {m}: {c}."]


def _case(at: str, branches: list[str]) -> str:
    return f"(CASE {at} " + " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(branches[:-1])) + f" ELSE {branches[-1]} END)"


def _noun_phrase(thing: str) -> str:
    return thing if thing in PAIRED + UNCOUNTED else ("an " if thing[0] in "aeiou" else "a ") + thing


def _upper_first(x: str) -> str:
    return f"(upper(left({x}, 1)) || substring({x}, 2))"


THINGS = sorted(FACTS)
PHRASES = [_noun_phrase(t) for t in THINGS]


def _sentences(thing: str) -> list[str]:
    """Every frame that fits the thing's predicate, filled in."""
    said, many, np = FACTS[thing], thing in PAIRED, _noun_phrase(thing)
    verb, _, rest = said.partition(" ")
    words = {"np": np, "NP": np[0].upper() + np[1:], "it": "they" if many else "it", "is": "are" if many else "is", "pred": said, "noun": rest}
    if verb == "is":
        return [f.format(**words) for f in NAMING]
    base = verb if many else inflected_word(verb, BASE_RULES)
    ing = f"{inflected_word(base, ING_RULES)} {rest}"
    return [f.format(**words, base=f"{base} {rest}", ing=ing, Ing=ing.capitalize()) for f in SAYING + USING + DOING]


def fact_sentence(d: Dialect, seed: int, key: str) -> tuple[str, str]:
    """(thing, sentence) drawn by key: a frame that fits the fact, and now and then a remark."""
    at = f"({d.draw(seed, key, 0)} % {len(THINGS)})"
    remark = f"CASE WHEN {d.draw(seed, key, 2)} % 100 < 35 THEN ' ' || {d.choice(seed, key, 3, REMARKS)} ELSE '' END"
    return d.pick(THINGS, at), f"{_case(at, [d.choice(seed, key, 1, _sentences(t)) for t in THINGS])} || {remark}"


def greeting(d: Dialect, seed: int, key: str) -> str:
    """One line, made of a beginning (four) and an end (three); 6 in 100 are whole lines of their own."""
    hello, note, ask, hedge = (d.choice(seed, key, i, pool) for i, pool in enumerate((SALUTES, NOTES, PROMPTS, HEDGES), start=1))
    second = d.pick(NOTES, f"({d.draw(seed, key, 2)} + 1 + {d.draw(seed, key, 5)} % {len(NOTES) - 1})")  # another one
    begin = _case(f"({d.draw(seed, key, 6)} % 4)", [hello, f"{hello} || ', ' || {note}", note, f"{hello} || '. ' || {note} || ', and ' || {second}"])
    end = _case(f"({d.draw(seed, key, 7)} % 3)", [ask, f"{hedge} || ' ' || {ask}", f"{ask} || ' ' || {hedge}"])
    return f"(CASE WHEN {d.draw(seed, key, 0)} % 100 < 6 THEN {d.choice(seed, key, 8, WHOLE_GREETINGS)} ELSE {begin} || '. ' || {end} END)"


def lyrical(d: Dialect, seed: int, key: str) -> tuple[str, str]:
    """(kind, sentence): a statement, a question or an opinion about something in the world."""
    with_article = lambda x: ("an " if x[0] in "aeiou" else "a ") + x
    pick = lambda i, xs: d.choice(seed, key, i, xs)
    parts = {"n": pick(1, NOUNS), "a": pick(2, [with_article(x) for x in QUALITIES]), "v": pick(3, VERBS), "b": pick(3, [inflected_word(x, BASE_RULES) for x in VERBS]), "w": pick(4, WHERE), "t": pick(5, WHEN), "c": pick(6, CAUSES), "m": pick(7, [with_article(x) for x in NOUNS])}
    parts |= {k.upper(): _upper_first(parts[k]) for k in "amt"}
    shapes = {"statement": STATEMENTS, "question": ASKED, "opinion": OPINIONS}
    kind = d.pick(list(shapes), d.weighted(seed, key, 0, [5, 3, 2]))
    text = _case(d.weighted(seed, key, 0, [5, 3, 2]), [d.choice(seed, key, 8, pool) for pool in shapes.values()])
    return kind, d.filled(text, parts)


def social_exchange(d: Dialect, seed: int, key: str) -> tuple[str, str]:
    """(prompt, reply)."""
    kind = d.weighted(seed, key, 0, SOCIAL_WEIGHTS)
    prompt, reply = (_case(kind, [d.choice(seed, key, 1 + side, pools[side]) for pools in SOCIAL.values()]) for side in (0, 1))
    more = _case(kind, [d.choice(seed, key, 4, pool) for pool in SOCIAL_MORE.values()])
    return prompt, f"({reply} || CASE WHEN {d.draw(seed, key, 3)} % 100 < 75 THEN ' ' || {more} ELSE '' END)"


def _named(d: Dialect, template: str, name: str) -> str:
    return f"replace({template}, '{{name}}', {name})"


def turn(d: Dialect, seed: int, key: str, kind: str) -> tuple[str, str, str]:
    """(prompt, reply, thought) of an exchange of one kind; "more" is the i-th (a column) to continue the known one
    of the same key. Draws 0 to 20."""
    at = f"({d.draw(seed, key, 0)} % {len(THINGS)})"
    name = d.pick(PHRASES, at)
    pool = lambda i, xs: d.choice(seed, key, i, xs)
    if kind == "known":
        prompt, reply = _named(d, pool(10, QUESTIONS), name), fact_sentence(d, seed, key)[1]
    elif kind == "more":
        prompt, reply = d.pick(MORE, f"({d.draw(seed, key, 4)} + i)"), d.pick(MORE_REPLIES, f"({d.draw(seed, key, 5)} + i)")
    elif kind == "unknown":
        name = f"({pool(11, MADE_UP[0])} || {pool(12, MADE_UP[1])})"
        prompt, reply = _named(d, pool(13, MADE_UP_QUESTIONS), name), pool(14, IGNORANCE)
    elif kind == "clarify":
        prompt, reply = _named(d, pool(15, VAGUE), name), _named(d, pool(16, ASK_BACK), name)
    elif kind == "chit":
        which = f"({d.draw(seed, key, 17)} % {len(CHIT)})"
        prompt, reply = _case(which, [quoted(q) for q, _ in CHIT]), _case(which, [pool(18, replies) for _, replies in CHIT])
    elif kind == "cannot":
        prompt, reply = pool(19, list(BEYOND)), pool(20, NO_ACCESS)
    else:
        prompt, reply = social_exchange(d, seed, key)
    return prompt, reply, _named(d, quoted(THOUGHTS[kind]), name)


#: What a question that starts so may become; {rest} is what follows, without its marks.
ASIDES = ["Can you say {whole}", "I am wondering {whole}", "Here is one for you: {whole}"]
REQUESTS = ["Describe {rest}.", "Give me an idea of {rest}.", "A word on {rest}, please."]
QUESTION = "^(What|Why|How|Where|When|Who) (is|are|do|does) (.+)$"
#: A rest that is one noun phrase: an article and one or two words.
PHRASE = "^(a|an|the) [a-z]+( [a-z]+)?$"


def paraphrased(d: Dialect, seed: int, key: str, body: str) -> str:
    """A question asked otherwise: "What is" with one noun phrase may become a request, any other is put behind an aside
    with its own words in order; what is no such question stays as it is."""
    bare = f"regexp_replace({body}, '[?]+$', '')"
    word, rest = (f"regexp_extract({bare}, {quoted(QUESTION)}, {i})" for i in (1, 3))
    whole = f"lower(left({bare}, 1)) || substring({bare}, 2) || '?'"
    aside = f"replace({d.choice(seed, key, 1, [a.replace('{whole}', '') for a in ASIDES])} || {whole}, '  ', ' ')"
    request = f"replace({d.choice(seed, key, 2, REQUESTS)}, '{{rest}}', {rest})"
    matches = f"{word} <> ''"
    phrase = f"{word} = 'What' AND regexp_extract({rest}, {quoted(PHRASE)}, 1) <> '' AND {d.draw(seed, key, 0)} % 3 < 2"
    return f"CASE WHEN {matches} AND {phrase} THEN {request} WHEN {matches} THEN {aside} ELSE {body} END"


def roughened(d: Dialect, seed: int, key: str, body: str) -> str:
    """A user's line as people type: a lost stop (30%), a small first letter (15%), ! for a stop (8%), a second ? (6%), in this order."""
    chance = lambda i, percent: f"{d.draw(seed, key, i)} % 100 < {percent}"
    stop = f"right({body}, 1) = '.'"
    lost = f"({chance(0, 30)} AND {stop})"
    first = f"CASE WHEN {lost} THEN left({body}, length({body}) - 1) ELSE {body} END"
    ends_in_stop = f"(right({first}, 1) = '.')"
    low = f"CASE WHEN {chance(1, 15)} THEN lower(left({first}, 1)) || substring({first}, 2) ELSE {first} END"
    loud = f"CASE WHEN {chance(2, 8)} AND {ends_in_stop} THEN left({low}, length({low}) - 1) || '!' ELSE {low} END"
    return f"CASE WHEN {chance(3, 6)} AND right({body}, 1) = '?' THEN {loud} || '?' ELSE {loud} END"


#: Ways to frame a written block anew.
LEADS, TAILS, STARTS = ["Let me see. ", "In brief: ", "Gladly. "], [" Shall I go on?", " So much for that.", " I hope that is clear."], ["Excuse me. ", "By the way, ", "One thing: "]


def reframed_line(d: Dialect, seed: int, conv: str, place: str, role: str, body: str) -> str:
    """A block's line anew: the first line is asked otherwise (55%) and opened (35%), a bot's line led (30%) and closed (20%)."""
    key = f"({d.text(conv)} || ':' || {d.text(place)})"
    chance = lambda i, percent: f"{d.draw(seed, key, i)} % 100 < {percent}"
    asked = f"(CASE WHEN {chance(50, 55)} THEN {paraphrased(d, seed, key, body)} ELSE {body} END)"
    opened = f"(CASE WHEN {chance(51, 35)} THEN {d.choice(seed, key, 52, STARTS)} ELSE '' END || {asked})"
    told = f"(CASE WHEN {chance(53, 30)} THEN {d.choice(seed, key, 54, LEADS)} ELSE '' END || {body} || CASE WHEN {chance(55, 20)} THEN {d.choice(seed, key, 56, TAILS)} ELSE '' END)"
    return f"CASE WHEN {role} <> 'user' THEN {told} WHEN {place} = 0 THEN {opened} ELSE {body} END"


DIALOGUE_UNITS, DIALOGUE_KINDS = 12, {"open": 28, "after": 42, "aside": 18, "change": 12}


def dialogue_ctes(d: Dialect, keys: str, seed: int) -> str:
    """CTEs; the last, ``lines``, has conv_id, turn, role, subject, line: dialogues of DIALOGUE_UNITS exchanges that stay with a subject until it is changed.

    Units are drawn by (conversation, unit). A unit that opens a subject names a thing; those after it are about the last one named since the
    subject was last changed (a running maximum of unit and thing, within the stretch between two changes), and each says another sentence about it.
    """
    unit = "(cast(conv_id as string) || ':s' || cast(u as string))"
    kinds, n = list(DIALOGUE_KINDS), len(THINGS)
    over = "OVER (PARTITION BY conv_id, stretch ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    np = d.pick(PHRASES, "subject")
    many = "subject IN (" + ", ".join(str(i) for i, t in enumerate(THINGS) if t in PAIRED) + ")"
    pool = lambda i, xs: d.pick(xs, f"e{i}")
    asked = f"CASE WHEN subject IS NOT NULL AND {many} THEN {pool(2, AFTER[True])} ELSE {pool(2, AFTER[False])} END"
    said = _case("subject", [d.pick(_sentences(t), "begun + u") for t in THINGS])
    prompt = f"CASE kind WHEN 'open' THEN {_named(d, pool(2, [o.replace('{np}', '{name}') for o in OPENINGS]), np)} WHEN 'after' THEN {asked} WHEN 'aside' THEN {pool(2, ASIDE)} ELSE {pool(2, CHANGES)} END"
    reply = f"CASE WHEN kind = 'change' THEN {pool(3, CHANGED)} WHEN kind = 'aside' THEN {pool(3, ASIDE_REPLIES)} WHEN subject IS NULL THEN {pool(3, NOTHING_YET)} ELSE {said} END"
    return f"""chosen AS (SELECT conv_id, u, {d.pick(kinds, d.weighted(seed, unit, 0, list(DIALOGUE_KINDS.values())))} AS kind, {d.draw(seed, unit, 1)} AS e1, {d.draw(seed, unit, 2)} AS e2, {d.draw(seed, unit, 3)} AS e3 FROM (SELECT DISTINCT conv_id FROM {keys}) k {d.lateral(str(DIALOGUE_UNITS - 1), 'u')}),
parted AS (SELECT *, sum(CASE WHEN kind = 'change' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stretch FROM chosen),
carried AS (SELECT *, max(CASE WHEN kind = 'open' THEN u * {n} + e1 % {n} END) {over} AS mention FROM parted),
about AS (SELECT conv_id, u, kind, e2, e3, mention % {n} AS subject, mention % {n} + conv_id AS begun FROM carried),
spoken AS (SELECT conv_id, u, CASE WHEN kind = 'change' THEN NULL ELSE subject END AS subject, {prompt} AS prompt, {reply} AS reply FROM about),
lines AS (SELECT conv_id, cast(2 * u + s as int) AS turn, CASE WHEN s = 0 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN subject IS NOT NULL THEN {d.pick(THINGS, 'subject')} END AS subject, CASE WHEN s = 0 THEN prompt ELSE reply END AS line FROM spoken {d.lateral('1', 's')})"""
