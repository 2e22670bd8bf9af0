import re

from llmcases import awkward, documents, frame, texts

from dealflow.llm import pii

TEXT = (
    "Mail Anna.Berg@mail3.example.com or call +1 (384) 555-3571, host 12.197.240.125, card "
    "4539 1488 0343 6467 and 4805476200170562, ssn 123-45-6789, password=c7ced47da88d44a3b8. "
    "Mr. John Smith met Mrs. SMITH and г-жа Анна Иванова; Mr. Smith left. anna.berg@mail3.example.com"
)


def test_types_formats_and_coreference(spark):
    rows = awkward() + [(30, TEXT), (31, TEXT), (32, "1-384-555-3571 on 2024-01-15 at 10.5 or 3.14 in 1990 1991 1992")]
    docs = frame(spark, rows)
    result = pii.surrogated(docs)
    assert result.columns == [*docs.columns, "n_entities"]
    got = {r.doc_id: r for r in result.collect() if r.doc_id in (30, 31, 32)}
    text = got[30].text
    assert text == got[31].text and got[30].n_entities == 12
    for private in ("Berg", "384", "3571", "12.197", "4539", "48054", "6789", "c7ced", "John", "mith", "Иванова"):
        assert private not in text and private.upper() not in text
    mails = re.findall(r"\S+@\S+\.com", text)
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower() and mails[0] != mails[1]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4},", text)
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4}) ", text).group(1).replace(" ", "")
    assert pii.luhn(card) == 0 and card[0] == "4"
    man, woman, lady, again = re.search(
        r"Mr\. (\w+ \w+) met Mrs\. (\w+) and г-жа (\w+ \w+); Mr\. (\w+) left", text
    ).groups()
    assert woman.isupper() and man.split()[1] == again == woman.title()
    assert man.split()[0] in pii.GIVEN[("latin", "m")].split()
    assert lady.split()[0] in pii.GIVEN[("cyrillic", "f")].split()
    # The same number, dressed otherwise, has the same surrogate; dates are no numbers.
    digits = re.sub(r"\D", "", re.search(r"call (.*?),", text).group(1))
    assert re.sub(r"\D", "", got[32].text.split(" on ")[0]) == digits
    assert got[32].text.endswith(" on 2024-01-15 at 10.5 or 3.14 in 1990 1991 1992")


def test_titles_mentions_and_genders(spark):
    rows = [
        (1, "Frau Dr. Weber kam. Prof. Dr. Weber ging, WEBER auch. Webers Haus."),
        (2, "Mr. John Smith came. Smith left. John Smith wrote. Johnson stayed, John too."),
        (3, "г-жа Анна Иванова и г-н Иванов. Иванова ушла."),
        (4, "Mr. Smith wrote to IBAN DE89 3704 0044 0532 0130 00 and GB00 1234 5678 9012 3456 78."),
        (5, "Call +49 30 1234567, +353 1 234 5678 or +1 (384) 555-3571."),
        (6, "Smith and Weber are names of others here."),
    ]
    got = {r.doc_id: r for r in pii.surrogated(frame(spark, rows)).collect()}
    one = re.fullmatch(r"Frau Dr\. (\w+) kam\. Prof\. Dr\. (\w+) ging, (\w+) auch\. Webers Haus\.", got[1].text)
    assert one[1] == one[2] == one[3].title() != "Weber" and one[3].isupper() and got[1].n_entities == 3
    two = re.fullmatch(r"Mr\. (\w+) (\w+) came\. (\w+) left\. (\w+) (\w+) wrote\. Johnson stayed, John too\.", got[2].text)
    assert two[1] == two[4] != "John" and two[2] == two[3] == two[5] != "Smith"
    three = re.fullmatch(r"г-жа (\w+) (\w+) и г-н (\w+)\. (\w+) ушла\.", got[3].text)
    assert three[1] in pii.GIVEN[("cyrillic", "f")].split()
    assert three[2] == three[4] == three[3] + "а" != "Иванова"
    ibans = re.findall(r"[A-Z]{2}\d\d(?: [A-Z0-9]{2,4})+", got[4].text)
    whole = [int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 for x in (i.replace(" ", "") for i in ibans)]
    assert [i[:2] for i in ibans] == ["DE", "GB"] and whole[0] == 1 and "3704" not in got[4].text
    assert re.search(rf"Mr\. {two[2]} wrote", got[4].text)
    five = re.fullmatch(r"Call (\+49 \d{2} \d{7}), (\+353 \d \d{3} \d{4}) or (\+1 \(\d{3}\) \d{3}-\d{4})\.", got[5].text)
    assert five and "1234567" not in got[5].text
    assert got[6].text == rows[5][1] and got[6].n_entities == 0


def test_full_spaces_get_longer(monkeypatch):
    """After many draws that were taken, a number of the same code and one digit more."""
    value = "4912345678"
    plain = [pii.surrogate("k", "phone:2", value, a) for a in (0, 15, 16, 40)]
    assert [len(p) for p in plain] == [10, 10, 11, 12] and all(p.startswith("49") for p in plain)
    assert re.fullmatch(r"\+49 \d{4} \d{5}", pii.shaped(plain[2], "+49 1234 5678", "phone:2"))


def plain_entities(text):
    """Another detector for the kinds that need no context, by simple rules on blank-cut words."""
    out = set()
    for word in re.split(r"\s+", text):
        bare = word.strip(".,;:!?()[]\"'")
        if re.fullmatch(r"[\w.+-]+@[\w-]+(\.[\w-]+)+", bare):
            out.add(bare)
        octets = bare.split(".")
        if len(octets) == 4 and all(o.isdecimal() and o.isascii() and len(o) < 4 and int(o) < 256 for o in octets):
            out.add(bare)
        if re.fullmatch(r"\d{3}-\d{2}-\d{4}", bare):
            out.add(bare)
    return out


def test_nothing_that_another_detector_finds_is_left(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    old = {r.doc_id: r.text or "" for r in docs.collect()}
    found = 0
    for r in pii.surrogated(docs).collect():
        private = plain_entities(old[r.doc_id])
        found += len(private)
        assert not [p for p in private if p in (r.text or "")], r.doc_id
    assert found > 20


def test_other_rows_stay(spark):
    rows = awkward()
    got = pii.surrogated(frame(spark, rows)).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, rows))


def test_whole_table(spark):
    old = dict(texts(spark))
    found = 0
    for r in pii.surrogated(documents(spark)).collect():
        entities = pii.detected(old[r.doc_id])
        assert r.n_entities == len(entities) and (r.text != old[r.doc_id]) == bool(entities)
        for entity in entities:
            found += 1
            assert old[r.doc_id][entity[0].start : entity[-1].end] not in r.text
    assert found > 5


def test_collisions_are_resolved(spark, monkeypatch):
    """More surnames than the list has: all different, none that occurs, looked up or joined."""
    names = [f"Name{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)] + ["Miller", "Davis"]
    docs = frame(spark, [(i, f"Mr. {n} came") for i, n in enumerate(names)])
    few = {r.doc_id: r.text for r in pii.surrogated(docs).collect()}
    many = {r.doc_id: r.text for r in pii.surrogated(docs, settings=pii.Settings(look_up=0)).collect()}
    assert few == many and len(set(few.values())) == len(names)
    assert not {t.split()[1] for t in few.values()} & set(names)
    other = pii.surrogated(docs, settings=pii.Settings(key="other")).collect()
    assert sum(few[r.doc_id] != r.text for r in other) > 60


def test_empty(spark):
    assert pii.surrogated(documents(spark).limit(0)).count() == 0
