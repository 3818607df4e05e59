from webwarden.llm import spam as m

EN = "Analysts closed the case because the sign-in form had already been removed. Visitors who forgot the password may ask the front desk for a new one. "
DE = "Das Zertifikat für a.test nennt acht weitere Namen und läuft bald ab. Wer die Kartennummer vergessen hat, wendet sich an die Zweigstelle. "
FR = "Les clients de la banque reçoivent un message qui promet des crédits. La page demande le mot de passe pour la carte. "
ES = "Quien haya olvidado la clave puede acudir a la oficina de la ciudad. El certificado caduca pronto y la página ya no está. "
LOG = '203.0.113.1 - - [11/Jan/2025:21:36:52 +0000] "POST /a/b HTTP/1.1" 404 34178\n'
DOCS = [
    *[(t * k, False) for t in (EN, DE, FR, ES) for k in (1, 2, 5)],
    ("velora pay bonus bank\nvelora pay bonus login\n" * 12, True),
    ("bank | login | bank | bonus | " * 15, True),
    (" ".join(f"#gift #giftcard{i}" for i in range(20)), True),
    ("\n".join(f"https://h{i}.test/a?b={i}" for i in range(16)), True),
    ("\n".join(f'<a href="https://h{i}.test/">login {i}</a>' for i in range(16)), True),
    ("\n".join(f"Havaplo{i} gutschein | {i}.99 | SKU-{i} | login" for i in range(12)), True),
    (EN[:77] + "\n\n" + "credit gift reset, " * 25, True),
    ("kredit Relor (67) online Gelrel (21) gutschein Helcroco (83) rabatt Delri (81) bank Tor (71) hilfe Rarel (18) konto Vi (4) paket Ka (25) karte Mo (1)", True),
    (EN + LOG * 40, False),
    (EN + "\n```\n" + "$x = getenv('A');\n" * 30 + "```\n", False),
    (EN * 2 + "\n" + "\n".join(f"* hxxps://h{i}.test/a" for i in range(12)), False),
    (EN + "\nHome | About | Contact | Login", False),
    ("bonus: " + EN + "\ncredit: " + EN, False),
    ("ok, 18:04", False),
    ("페이지가 사라졌습니다. 나중에 다시 시도하세요.", False),
]


def test_documents(spark):
    rows = [(i, t, ["en", None, "XX"][i % 3], 1) for i, (t, _) in enumerate(DOCS)] + [(90, None, "en", 1), (91, " \n", "en", 1), (92, "\x07", None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, total int")
    got = {r["doc_id"]: r["is_spam"] for r in m.spam_verdicts(df).collect()}
    assert got == {i: w for i, (_, w) in enumerate(DOCS)}
    assert m.spam_verdicts(df.limit(0)).count() == 0


def test_long_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "login bonus | " * 20000, None), (1, "login bonus | " * 20000, None), (2, EN * 500, None)], "doc_id bigint, text string, lang string")
    got = sorted((r["doc_id"], r["is_spam"]) for r in m.spam_verdicts(df).collect())
    assert got == [(1, True), (1, True), (2, False)]


def test_segments_mark_what_is_neutral():
    parts = list(m.segments("One. Two!\n" + LOG + "```\ncode\n```\nhxxp://a.test\n\nThree"))
    assert [n for _, n in parts] == [False, False, True, True, True, False]


def test_long_odd_texts_are_quick():
    import time

    start = time.time()
    for text in ("a-" * 100_000 + ". b", "a." * 100_000, "x" * 300_000, "| " * 100_000, "https://" * 40_000, "[url=" * 50_000 + ".", ". " * 100_000):
        assert m.measured(text, None) is not None
    assert time.time() - start < 20


#: Languages without fixed function words: plain prose, and words that spam repeats.
OTHERS = {
    "pl": ("Analityk zamknął sprawę, ponieważ formularz logowania został już usunięty ze strony. Klienci banku otrzymują wiadomość, która obiecuje zwrot pieniędzy, ale prowadzi do fałszywej witryny. Kto zapomniał hasła, może zgłosić się do oddziału w mieście. Serwer odpowiada od wczoraj inną stroną i ukrywa pole adresu.", "kredyt bonus bank logowanie hasło gratis"),
    "tr": ("Analist, giriş formu sayfadan zaten kaldırıldığı için dosyayı kapattı. Bankanın müşterileri para iadesi vaat eden bir mesaj alıyor, ancak bağlantı sahte bir siteye gidiyor. Şifresini unutanlar şehirdeki şubeye başvurabilir. Sunucu dünden beri başka bir sayfa gösteriyor.", "kredi bonus banka giriş şifre bedava"),
    "fi": ("Tutkija sulki tapauksen, koska kirjautumislomake oli jo poistettu sivulta. Pankin asiakkaat saavat viestin, joka lupaa hyvitystä, mutta linkki vie väärennetylle sivustolle. Salasanansa unohtanut voi kysyä uutta konttorista. Palvelin on eilisestä lähtien näyttänyt toista sivua.", "laina bonus pankki kirjaudu salasana ilmainen"),
    "it": ("L'analista ha chiuso il caso perché il modulo di accesso era già stato tolto dalla pagina. I clienti della banca ricevono un messaggio che promette un rimborso, ma il collegamento porta a un sito falso. Chi ha dimenticato la parola chiave può rivolgersi alla filiale in città.", "prestito bonus banca accesso gratis rimborso"),
    "nl": ("De analist sloot de zaak omdat het aanmeldformulier al van de pagina was gehaald. Klanten van de bank krijgen een bericht dat een terugbetaling belooft, maar de koppeling leidt naar een valse site. Wie het wachtwoord vergeten heeft, kan bij het filiaal terecht.", "lening bonus bank inloggen gratis korting"),
}


def test_languages_without_fixed_function_words(spark):
    rows, want = [], {}
    for code, (prose, keys) in OTHERS.items():
        words = keys.split()
        mixed = " ".join(words[i * i % len(words)] for i in range(60))
        tags = " | ".join(f"{words[i % 6]} {words[i * 5 % 6]} {i}.99" for i in range(20))
        links = "\n".join(f"https://h{i}.test/{words[i % 6]}?a={i}" for i in range(16))
        first = prose.split(". ")[0] + "."
        for text, spam in ((prose, False), (first, False), (prose.replace(". ", ".\n"), False), (mixed, True), (tags, True), (links, True), (first + "\n" + mixed, True)):
            for lang in (code, None, "en"):
                want[len(rows)] = spam
                rows.append((len(rows), text, lang))
    # The thresholds are those of a corpus: fifty documents of running text in a known language.
    rows += [(len(rows) + i, f"{EN}{EN.replace('form', f'form{i}')}"[: 300 + i], "en") for i in range(m.LEARN_DOCS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["is_spam"] for r in m.spam_verdicts(df).collect()}
    wrong = [(rows[i][2], rows[i][1][:60], got[i]) for i in want if got[i] != want[i]]
    assert not wrong, wrong


def test_function_words_are_learnt_from_document_frequency(spark):
    prose = OTHERS["nl"][0].split(". ")
    rows = [(i, f"{prose[i % len(prose)]}. {prose[(i + 1) % len(prose)]}.", "nl-NL" if i % 2 else " NL ") for i in range(m.LEARN_DOCS)] + [(900 + i, "kaas brood kaas brood", "fi") for i in range(m.LEARN_DOCS - 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learnt = m.learnt_words(df, "text", "lang")
    assert set(learnt) == {"nl"} and {"de", "het", "van", "een"} <= set(learnt["nl"])
    lang, words, function, *_ = m.measured(OTHERS["nl"][0], None, m.Lexicon(learnt))
    assert lang == "nl" and sum(function) > 0.3 * sum(words)
