import pytest
from pyspark.sql import functions as F

from sievemill.llm import language, pairs

PROMPT = "Host alpha-7 running Widget 4.2 writes bearer tokens to a world-readable log via handler beta_gamma, and any shell user can reuse live sessions (CVE-2031-12345)."
SOUND = ["['T1190']", '["T1190", "T1059.001"]', "T1190\nT1059", "[]", "[ ]", '{"techniques": []}', "Techniques: T1190, T1059", "No technique can be assigned with confidence from this summary.", "I cannot confirm that anyone used this flaw, but the exposure fits T1190.", 'This looks like T1190; the apology page saying "sorry, access denied" does not stop the caller.', '```json\n{"techniques": [{"id": "T1190", "reasoning": "The service is unable to reject forged input."}]}\n```', f"Summary: {PROMPT}\nTechniques: ['T1190']", "The best fit is T1190, because files outside the share can be read."]
BAD = {
    "empty": [None, "", " \n", "None", "n/a", "...", "```\n```", "​", '""', "(no output)", "\xa0"],
    "refusal": ["I'm sorry, but I can't help with that request.", "As a language model I am not able to provide guidance on intrusions.", '{"error": "request declined", "reason": "unsafe topic"}', "I must decline. Please consult a professional.", "This prompt was blocked by the content filter and no answer was produced."],
    "truncated": ["['T1190', 'T10", "['T1190'", '{"techniques": [{"id": "T1190", "name": "remo', "Answer: T1190. The weakness is reacha", "The best fit is T1190, because…", "T1190, T1059,"],
    "copy": [PROMPT, PROMPT.upper(), f'"{PROMPT}"', f"{PROMPT}\n{PROMPT}", f"### Log:\n{PROMPT}", PROMPT.replace("writes", "wrote")],
    "other_language": ["Der Befund passt zu T1190, weil der Dienst ohne Anmeldung erreichbar ist.", "Solo se describe una debilidad y ningún ataque, por eso T1190 es lo más prudente.", "Описана только слабость, поэтому T1190 подходит лучше всего.", "文中只描述了弱点，没有攻击，因此选择 T1190。该服务无需登录即可访问，模块没有检查输入。任何人都可以利用这个漏洞。"],
}


@pytest.fixture(scope="module")
def answers():
    rows = [(i, PROMPT, a, None) for i, a in enumerate(SOUND * 20)]
    rows += [(1000 + i, PROMPT, a, k) for k, texts in BAD.items() for i, a in enumerate(texts, start=100 * list(BAD).index(k))]
    return rows


def test_kinds(spark, answers):
    df = spark.createDataFrame([(i, p, a) for i, p, a, _ in answers], "mapping_id long, finding_summary string, raw_model_output string").withColumn("prompt", F.lit("clash"))
    got = {r.mapping_id: r.defect_type for r in pairs.defects(df.union(df), "mapping_id", "finding_summary", "raw_model_output").collect()}
    want = {i: k for i, _, _, k in answers if k}
    assert {i: (k, want.get(i)) for i, k in got.items() if want.get(i) != k} == {}
    assert set(got) == set(want)


def test_null_prompt_has_no_copy_and_no_language(spark):
    rows = [(1, None, "Der Befund passt zu T1190, weil der Dienst ohne Anmeldung erreichbar ist."), (2, None, None), (3, "", PROMPT), (None, "x", None)]
    got = pairs.defects(spark.createDataFrame(rows, "id long, q string, a string"), "id", "q", "a").collect()
    assert {r.id: r.defect_type for r in got} == {2: "empty"}


def test_latest_answer_decides(spark):
    rows = [(1, PROMPT, None, 1), (1, PROMPT, "['T1190']", 2)]
    df = spark.createDataFrame(rows, "id long, q string, a string, t long").withColumn("t", F.timestamp_seconds("t").cast("timestamp_ntz"))
    assert pairs.defects(df, "id", "q", "a", order="t").collect() == []


def test_empty_and_very_long(spark):
    schema = "id long, q string, a string"
    assert pairs.defects(spark.createDataFrame([], schema), "id", "q", "a").collect() == []
    long = "The service answers before any logon takes place. " * 20_000
    got = pairs.defects(spark.createDataFrame([(1, PROMPT, long + "T1190 fits."), (2, PROMPT, "[" * 5000)], schema), "id", "q", "a").collect()
    assert {r.id: r.defect_type for r in got} == {2: "empty"}


#: Held out: languages and phrasings that no training sentence holds.
LANGUAGES = [
    ("The attacker can read all of the files without a password.", "en"), ("Der Angreifer kann alle Dateien ohne Kennwort lesen.", "de"), ("L'attaquant peut lire tous les fichiers sans mot de passe.", "fr"), ("攻击者可以读取所有文件。", "zh"), ("Злоумышленник может читать все файлы.", "ru"), ("1234 !!", None),
    ("Bu hizmet kimlik doğrulaması olmadan erişilebilir durumda.", "tr"), ("Palvelu vastaa ilman kirjautumista ja hyökkääjä voi lukea tiedot.", "fi"), ("Služba odpovídá bez přihlášení a útočník může číst data.", "cs"), ("يمكن للمهاجم قراءة البيانات بدون كلمة مرور", "ar"), ("攻撃者はデータを読むことができます", "ja"), ("공격자는 데이터를 읽을 수 있습니다", "ko"),
    ("Ο εισβολέας μπορεί να διαβάσει τα δεδομένα", "el"), ("ხელმისაწვდომია პაროლის გარეშე", "georgian"), ("Xqzvk wrtplm qqzzx vbnkt jhgfd zxcvb", "unknown"), ("Angriparen kan läsa alla filer utan lösenord, och ingen märker det.", "sv"), ("Atacatorul poate citi toate fișierele fără parolă.", "ro"), ("Napadač može čitati sve datoteke bez lozinke.", None),
]


@pytest.mark.parametrize(("text", "lang"), LANGUAGES)
def test_language(text, lang):
    got = language.detect(language.words_of(text))[0]
    assert got == lang if lang or text[0].isdigit() else got != "en"


FOREIGN = ["Bu hizmet kimlik doğrulaması olmadan erişilebilir durumda, bu nedenle T1190 seçildi.", "Teenus vastab ilma sisselogimiseta ja ründaja saab andmeid lugeda, seega sobib T1190.", "Ο εισβολέας μπορεί να διαβάσει τα δεδομένα χωρίς κωδικό, άρα T1190.", "ผู้โจมตีสามารถอ่านข้อมูลได้โดยไม่ต้องใช้รหัสผ่าน จึงเลือก T1190", "Napadač može čitati sve datoteke bez lozinke, pa je T1190 najbolji izbor."]
SAID = ["Any caller can read the export, hence T1190 seems the closest label.", "T1059: the script host runs whatever the ticket field contains.", "Two candidates remain, T1190 and T1133; the exposed portal speaks for the former.", "Cipher suites were negotiated downward (T1557)."]


@pytest.mark.parametrize(("answer", "foreign"), [(a, True) for a in FOREIGN] + [(a, False) for a in SAID])
def test_other_language_is_told_in_unseen_languages(answer, foreign):
    assert pairs.is_other_language(answer, PROMPT) == foreign


REFUSED = ["I won't be producing that.", "Let us not go there; ask someone else.", "Sorry, this is a matter I may not touch.", "Nope, I don't help with break-ins.", '{"note": "I cannot discuss this subject."}', "My rules forbid such replies.", "I'd prefer to talk about other subjects.", "Lamento, no puedo ayudar con esta solicitud."]
DONE = ["No entry of the matrix covers this.", "I am not sure, nothing in the text names a behaviour.", "The daemon refuses valid tickets and cannot recover.", "The parser is unable to reject forged tokens.", "Users are not allowed to change it, the vendor says.", '{"techniques": [], "note": "Nothing in it points to a technique."}', "I cannot tell which label applies."]


@pytest.mark.parametrize(("answer", "refused"), [(a, True) for a in REFUSED] + [(a, False) for a in DONE])
def test_refusals_in_unseen_words(answer, refused):
    assert pairs.is_refusal(answer) == refused


def test_end_of_text_model_decides_running_text(spark):
    sound = ["Anyone on the segment can replay the ticket, so T1558 fits.", "T1021\nT1078", "['T1190']", "T1110 (brute force)", "Likely T1499, as the queue never drains!"] * 40
    cut = ["Anyone on the segment can replay the tick", "The broker trusts the header and", "It fits T1499, since the queue nev"]
    df = spark.createDataFrame([(i, PROMPT, a) for i, a in enumerate([*sound, *cut])], "id long, q string, a string")
    got = {r.id: r.defect_type for r in pairs.defects(df, "id", "q", "a").collect()}
    assert got == {len(sound) + i: "truncated" for i in range(len(cut))}


@pytest.mark.parametrize(("prompt", "answer", "copy"), [("Weak TLS cipher", '"weak TLS cipher."', True), ("Weak TLS cipher", "Summary: Weak TLS cipher", True), ("该服务无需登录即可访问", "该服务无需登录即可访问。", True), ("Weak TLS cipher", "Weak TLS cipher T1190", False), ("Weak TLS", "Weak SSH", False), ("...", "!", False), (None, "x", False)])
def test_copy_of_a_short_summary(prompt, answer, copy):
    assert pairs.is_copy(answer, prompt) == copy
