"""Sentences of many languages and layouts, written out by hand; a bar marks every boundary."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm.sentences import WHITE, language_code, sentences, split_sentences

CASES = [
    "Formanden, H. R. G.J. Fjelkær, trak sig pga. sygdom. | Selskabet hedder nu Nordvig Færger A/S. | Det var 12 mål! | iTavlen viser nu 4 afgange.",
    "Deltagerne kom fra klubber m.v. | Toget kører kl. 3.55 fra Havnnæs og er fremme kl. 9.23. | 5 personer meldte sig, dvs. 9 flere end sidst.",
    "»Vi er klar.« | Beboerforeningen roste planen. | »Vi er klar?« spurgte Pramkær og rejste sig. | Prisen er 45 kr. | Byrådet sagde nej.",
    "Ifølge Tjelborg var svaret: »Jeg har ventet i 28 år. Jeg har ventet.« | Der var 56.209 tilskuere. | Elever fra 10. klasse læste nr. 5 op for hr. Pramlund m.fl. i aulaen.",
    "Vejen lukkes fra d. 19. maj til d. 11. juni. | Broen (bygget ca. 1931, jf. skiltet!) er stadig lukket. | Han tøvede ... og gik så hjem.",
    "Der Zug fährt am 3. Mai um 2.14 Uhr ab Lyvig. | Der Bau beginnt im 2. Quartal bzw. im 3. | Wer soll das bezahlen? | Man braucht z.B. ca. 14 Helfer, u.a. Prof. Brunlund und Fr. Stavmark.",
    "„Das hält nicht. Wir sind bereit“, sagte Vestdal. | „Wir sind bereit?“, fragte Gramlund. | Die Firma heißt jetzt Fjellund & Co. | Er zögerte … und ging dann doch.",
    "Gen. Ovstnes (ret.) opened the fair. | The firm is now called Lines Inc. | Lillevig Rowing Club met at 4:06 a.m. on Friday. | The trip ended at 6 a.m. | The span (built c. 1931, shut twice!) stays closed.",
    "“Somebody has to answer.” | The ferry company agreed. | “I waited 5 years?” asked Brunholt, standing up. | It cost $32.6m on Feb. 2 🎉. | St. K. Ovstnes came, e.g. from Lyfjord.",
    "He waited for 3.5 hours! Really?! | Yes. | \"We are ready! We are,\" he said. | See Sec. 8 of No. 24.".replace("hours! Really", "hours! | Really"),
    "居民表示：“我们准备好了。”|主队教练公布了计划。|“我们准备好了。没有人问过我们。”教练说。|「没有人问过我们！」观众喊道。|他停了一下……然后签了字。|价格上涨了9.7%。|真的吗？！",
    "「誰も聞いてくれない。準備はできた。」と監督は述べた。|住民は『準備はできた。誰も』と書いた。|誰が払うのか？",
    "—Esto no es todo —dijo N.M. Tjelborg—, pero basta. | ¿Quién lo va a pagar? | —Esto no es todo. | Unos 28.053 vecinos, p. ej. de Søndervig, firmaron. | Dudó... y luego firmó. | La Dra. Brun leyó el art. 8.",
    "«Нас никто не спросил. Мы готовы», — сказал тренер. | «Мы готовы!» — крикнули из зала. | Там были лодки, сети и т. д. | Музей одобрил. | Продают, т. е. отдают, 30 тыс. билетов. | По данным г. Фьорд, рост 4,5 проц. за год.",
    "“हम तैयार हैं। हम तैयार हैं।” कोच ने कहा। | लगभग 10 नावें सुबह 6.10 बजे निकलीं। | डॉ. नेगी के अनुसार दाम बढ़ा।",
    "ราคาเพิ่มขึ้นร้อยละ13.2จากปีก่อน | ใครจะเป็นคนจ่าย | โค้ชกล่าวว่า“เราพร้อมแล้ว” | ชนะแล้ว! | ทีมเจ้าบ้าน",
    "Ο κ. Fjelsen ήρθε στις 4.51. | Ποιος θα πληρώσει; | «Κανείς δεν ρώτησε. Είμαστε έτοιμοι», είπε ο προπονητής. | Πουλάνε σχοινιά κ.λπ. | Το σχολείο, δηλ. περ. 25.",
    "« Nous sommes prêts ? » demanda Xavier. | Le Dr. Mornfeldt et Mme Brun ont lu l'art. 13. | La vente commence à 9 h. | Il hésita… puis signa.",
    "وفق د. سالم. | المجلس وافق. | «نحن جاهزون. لم يسألنا أحد»، قال المدرب. | ماذا بعد؟ | ارتفع 17.8 في المئة.",
    "”Ingen frågade oss. Vi är redo”, säger Jerndal. | ”Vi är redo!” ropade Gramlund. | Bl.a. såldes ca. 13 båtar, t.ex. nr. 12. | De säljer rep, färg m.m. | Enl. dr Pramborg ökade antalet.",
    "Planen blev godkendt i år.|Teatret roste den.",
    # what one language abbreviates is a word of another
    "Das gehört dir. | Ich gehe jetzt. | Hans talte med dir. Holm om det.",
    "Det vet jag ej. | Han gick hem. | Vi ska dra. | Sedan kommer de.",
    "We walked down Main St. | Then it rained. | They came to St. Ives and St. K. Brun was there. | He loves art. | 3 people came.",
    "Se venden redes, p. ej. de pesca. | La Dra. Brun leyó el art. 8 de la ley.",
]


@pytest.mark.parametrize("marked", CASES)
def test_case(marked):
    want = [s.strip() for s in marked.split("|")]
    text = marked.replace(" | ", " ").replace("|", "")
    assert [text[a:b] for a, b in sentences(text)] == want


def test_labels_count_where_words_tell_little():
    assert language_code(" DAN ") == "da" and language_code("en-GB") == "en" and language_code("xx") is language_code(None) is language_code("") is None
    text = "La Dra. Brun."
    assert len(sentences(text, "es")) == 1 and sentences(text, "nonsense") == sentences(text, None)


def test_layouts():
    text = "\r\n Nr. 13 på listen vandt\r\n\r\nAf Asbeved\n \t\nDette er\nen sætning. Og\xa0en til\n\n　slut"
    assert [text[a:b] for a, b in sentences(text)] == ["Nr. 13 på listen vandt", "Af Asbeved", "Dette er\nen sætning.", "Og\xa0en til", "slut"]
    assert sentences(None) == sentences("") == sentences(" \n\t\xa0　\r\n") == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1 .!?\n\"“”»«„(),:;…。！」「 ’‘—ก。हあ🎉éЯ·\r\t　", max_size=60))
def test_every_character_lies_in_one_sentence(text):
    last = 0
    for a, b in sentences(text):
        assert last <= a < b and not text[last:a].strip(WHITE)
        assert text[a] not in WHITE and text[b - 1] not in WHITE
        last = b
    assert not text[last:].strip(WHITE)


def test_very_long_text_is_linear():
    text = "»Å. " * 200_000 + "Det er slut. "
    assert sentences(text)[-1][1] == len(text) - 1


def test_table(spark):
    df = spark.createDataFrame([(1, "A b. 🎉 C d.", 7), (1, "A b. 🎉 C d.", 7), (2, None, 7), (3, "  ", 7), (None, "Hej du.", 7)], "doc_id bigint, text string, start_pos int")
    got = sorted((tuple(r) for r in split_sentences(df, lang=None).collect()), key=repr)
    assert got == sorted([(1, 0, 6), (1, 7, 11), (1, 0, 6), (1, 7, 11), (None, 0, 7)], key=repr)
    assert split_sentences(df.limit(0), lang=None).count() == 0
    named = df.withColumn("lang", df["text"])
    assert sorted((tuple(r) for r in split_sentences(named).collect()), key=repr) == got
