import pytest

from trackloom.llm import pii as P
from trackloom.llm import pii_spans as S
from trackloom.session import read_table


def test_reliabilities_find_the_labelers_that_agree():
    """The first labeler is a coin, the second and third agree: EM has to trust the latter."""
    patterns = {(1, 1, 1, 0, 0): 200, (0, 1, 1, 0, 0): 210, (1, 0, -1, 0, 0): 800, (0, 0, -1, 0, 0): 790}
    trust = P.reliabilities(patterns)
    assert trust.chance((0, 1, 1, 0, 0)) > 0.9 > 0.1 > trust.chance((1, 0, -1, 0, 0))
    assert P.reliabilities({}).chance((1, 1, 1, 0, 0)) < 0.01
    assert all(P.unpacked_votes(P.packed_votes(v)) == v for v in patterns)


@pytest.fixture(scope="module")
def trained(spark, small):
    docs, members = read_table(spark, small.replace("sf0.001", "sf0.01"), "documents"), read_table(spark, small.replace("sf0.001", "sf0.01"), "members")
    return P.fit(docs, members), members


# Sentences in frames that stand in no table of cue words and in no training text.
HELD_OUT = [
    ("A constituent, Kwame Mensah, wrote about the rent.", {("person", "Kwame Mensah")}),
    ("Peter Oltan lives next door.", {("person", "Peter Oltan")}),
    ("I met Anna Keller yesterday.", {("person", "Anna Keller")}),
    ("Mr Oltan was ill for weeks.", {("person", "Oltan")}),
    ("I saw Mr Peter de la Cruz there.", {("person", "Peter de la Cruz")}),
    ("He lives at 1600 Oltan Avenue.", {("address", "1600 Oltan Avenue")}),
    ("Her passport C01X00T47 was lost.", {("id_number", "C01X00T47")}),
    ("Her social number 123-45-6789 was stolen.", {("id_number", "123-45-6789")}),
    ("Signed by Kai Wu as tenant. Wu has left.", {("person", "Kai Wu"), ("person", "Wu")}),
    ("Das war der Antrag von Jan van den Berg aus Bonn.", {("person", "Jan van den Berg")}),
    ("Meine Nachbarin Petra Schulz wohnt in der Hauptstraße 12044.", {("person", "Petra Schulz"), ("address", "Hauptstraße 12044")}),
    ("La señora Lucía Fernández vive en calle Mayor 5.", {("person", "Lucía Fernández"), ("address", "calle Mayor 5")}),
    ("Mme Claire Fontaine habite 12 rue de Rivoli.", {("person", "Claire Fontaine"), ("address", "12 rue de Rivoli")}),
    ("The caretaker, Mr J. Oltan-Ruiz, can be phoned on 01632 960 111.", {("person", "J. Oltan-Ruiz"), ("phone", "01632 960 111")}),
    ("Dial +44 20 7946 0018 after six.", {("phone", "+44 20 7946 0018")}),
    ("Please mail olga.p@rent.example about it.", {("email", "olga.p@rent.example")}),
    ("The Minister of Finance spoke to the House Committee on Monday.", set()),
    ("In New York the Central Bank raised 1200 million in 2019.", set()),
    ("Case 4471-2210-8 was adjourned; invoice 88231907 is unpaid.", set()),
    ("Die Gemeinde Lunau zahlt dem Land Sachsen 9431 Kronen.", set()),
]


def test_frames_never_seen(trained):
    """Recall and precision of at least 0.9 of each kind and of all on sentences unlike those of the corpus."""
    finder, _ = trained
    got = {(i, k, t[s:e]) for i, (t, _) in enumerate(HELD_OUT) for s, e, k in finder.spans(t)}
    want = {(i, *x) for i, (_, w) in enumerate(HELD_OUT) for x in w}
    for kind in (*S.KINDS, None):
        own, true = {x for x in got if kind in (x[1], None)}, {x for x in want if kind in (x[1], None)}
        assert len(own & true) >= 0.9 * len(true) and len(own & true) >= 0.9 * len(own), (kind, true - own, own - true)


def test_sentences_like_the_corpus(trained):
    finder, members = trained
    member = members.first()["full_name"]
    cases = [
        ("The letter, sent from mira.oltan@mail.example, was signed by Mira Oltan as tenant. I told Ms Oltan that I would raise it.", {("email", "mira.oltan@mail.example"), ("person", "Mira Oltan"), ("person", "Oltan")}),
        ("Write to mo (at) box (dot) test. Order.", {("email", "mo (at) box (dot) test")}),
        ("My office was told to ring 0632/960726 and ask for OLTAN, Mira.", {("phone", "0632/960726"), ("person", "OLTAN, Mira")}),
        ("The form shows insurance number 840905-5192 beside the name M. Oltan.", {("id_number", "840905-5192"), ("person", "M. Oltan")}),
        ("Docket number 840905-5192 is closed. Petition 635 908 190 was received. Paper 1973-871-654 is on the table.", set()),
        ("Delivery was refused at 23B Oltan Road and again at 9 Mirk St. today.", {("address", "23B Oltan Road"), ("address", "9 Mirk St.")}),
        ("Der Bote fand in Oltanweg 91c niemanden. Unter Oltaner Allee 43 fehlt das Wasser. Im Jahr 1959 lieh man.", {("address", "Oltanweg 91c"), ("address", "Oltaner Allee 43")}),
        ("Au 1 ter, avenue de Mareval, l'eau manque. M. Oltan attend depuis 3 jours.", {("address", "1 ter, avenue de Mareval"), ("person", "Oltan")}),
        ("En avenida de Miraval, n.º 84 sigue faltando el agua.", {("address", "avenida de Miraval, n.º 84")}),
        ("Ring 0632 960\n726 (Applause) today.", {("phone", "0632 960\n726")}),
        (f"The vote at 14:30 @ Committee Room 39B stands. {member}: I thank {member} for that. (Mr {member.split()[-1]}: Shame!)", set()),
        ("", set()), (None, set()), ("word " * 50_000, set()), ("A B. " * 5_000, None), ("1 2 3 " * 5_000, None), ("((" * 3_000, set()),
    ]
    for text, want in cases:
        found = {(kind, text[s:e]) for s, e, kind in finder.spans(text)}
        assert want is None or found == want, text
    assert finder.redacted(cases[3][0]) == "The form shows insurance number [ID_NUMBER] beside the name [PERSON]."
    assert finder.redacted(None) is None


def test_members_in_any_spelling_are_no_candidates():
    reader = S.Reader(S.Gazetteer.of(["Élodie Marchal", "Jo Wu", "", "Cher"]))
    for name in ("Élodie Marchal", "ELODIE MARCHAL", "Marchal, Elodie", "E. Marchal", "Mme Marchal", "Mr Jo Wu", "Ms Wu"):
        assert [c for c in reader.candidates(f"We thank {name} for this.") if c.kind == S.PERSON_KIND] == [], name
    assert len(reader.candidates("We thank Paul Marchal for this.")) == 1


def test_context_is_read_in_words_of_the_sentence():
    text = "They left. Petition (Several Members, at great length and more than once: Withdraw!) 403 531 140 (Noise) was " + "x" * 300 + " received."
    at = text.index("403")
    assert S.words_before(text, at) == ["petition"] and S.words_after(text, at + 11, 2) == ["was", "x" * 300]
    inner = "Order (alpha beta gamma delta) now"
    assert S.words_before(inner, inner.index("gamma")) == ["alpha", "beta"] and S.words_after(inner, inner.index("gamma") + 5) == ["delta"]


def test_tables(spark, trained):
    finder, members = trained
    docs = spark.createDataFrame([(1, "Call x@y.example or x@y.example."), (2, None), (3, "")], "doc_id long, text string").selectExpr("*", "0 AS Kind")
    assert [tuple(r) for r in P.found_details(docs, finder).collect()] == [(1, "email", "x@y.example")]
    out = {r["doc_id"]: r["text"] for r in P.redact(docs, finder).collect()}
    assert out == {1: "Call [EMAIL] or [EMAIL].", 2: None, 3: ""}
    assert P.found_details(docs.limit(0), P.fit(docs.limit(0), members)).count() == 0
    assert P.personal_details(docs.limit(0), members.limit(0)).count() == 0
    keyed = docs.selectExpr("string(doc_id) AS kind_id", "text")
    assert P.found_details(keyed, finder, key="kind_id").first()["kind_id"] == "1"


def test_stored_candidates_are_judged_like_texts(spark, trained, small):
    finder, _ = trained
    docs = read_table(spark, small, "documents")
    direct = {(r["doc_id"], kind, r["text"][s:e]) for r in docs.collect() for s, e, kind in finder.spans(r["text"])}
    assert direct == {tuple(r) for r in P.found_details(docs, finder).collect()} and direct
