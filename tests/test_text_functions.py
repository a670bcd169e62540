from pyspark.sql import functions as F

from askwright.functions import entities, quotes, segment, stats, unicode_text


def canon(text):
    return [e["canonical"] for e in entities.extract(text)]


def test_entities():
    assert canon("Erreur 0x80070005 puis -2147024891") == ["err:0x80070005", "err:0x80070005"]
    assert canon("erreur 1603, event id 4625") == ["err:1603", "evt:4625"]
    assert canon("KB0012345 et KB893803, INC0012345") == ["kb:KB0012345", "update:KB893803", "ticket:INC0012345"]
    assert canon(r"Supprimer C:\Program Files\Outlook\x.dat.") == [r"path:c:\program files\outlook\x.dat"]
    assert canon(r"HKCU\Software\X") == [r"reg:hkey_current_user\software\x"]
    assert canon("Voir https://Example.COM/Aide/ puis ctrl + maj + esc") == ["url:https://example.com/Aide", "key:ctrl+shift+esc"]
    assert canon("Lancer ipconfig /flushdns sous Windows 10") == ["cmd:ipconfig /flushdns", "os:windows-10"]
    assert canon("Allez dans Fichier > Options > Courrier") == ["menu:fichier > options > courrier"]
    assert canon("Microsoft Teams") == ["app:teams"] and entities.extract(None) == []


def test_clean_and_find(spark):
    pages = {"<p>A&nbsp;B</p><ul><li>x</li><li>y</li></ul>": "A B\n\n- x\n\n- y", "a\r\n\n\n\nb  c\n   - d": "a\n\nb c\n   - d", "x &lt; y": "x < y"}
    rows = spark.createDataFrame([(h,) for h in pages], "h string").select("h", unicode_text.clean_text(F.col("h")).alias("t")).collect()
    assert {r.h: r.t for r in rows} == pages
    assert unicode_text.normal_form('( a "b c" d ;  e')[0] == '(a"b c"d; e'
    marked = "Étape 1. Cliquez sur **OK** puis"
    a, b = quotes.find_quote(marked, "1. Cliquez sur **OK**")
    assert marked[a:b] == "Cliquez sur **OK**"
    text = "Ouvrez  « Outlook » ,\npuis Redémarrez."
    a, b = quotes.find_quote(text, "puis redémarrez")
    assert text[a:b] == "puis Redémarrez" and quotes.find_quote(text, "xyz") is None and quotes.find_quote(None, "a") is None


def test_segments(spark):
    text = "# Symptôme\nRien\n# Résolution\n1. Cliquez ici\n   - Vérifiez le nom\n2. Si erreur, passez à l'étape 1\n# Si le problème persiste\n- Redémarrez"
    roles = [s["role"] for s in segment.sections(text)]
    assert roles == ["symptom", "resolution", "resolution"]
    found = segment.steps(text)
    assert [(s["kind"], s["level"], s["goto"], s["after_failure"]) for s in found] == [("action", 0, None, False), ("check", 1, None, False), ("action", 0, 1, False), ("action", 0, None, True)]
    assert all(text[s["start"] : s["end"]] == s["text"] for s in found) and found[2]["condition"] == "Si erreur"
    rows = spark.createDataFrame([(text,), (None,)], "t string").select(F.size(segment.steps_udf("t")).alias("n"), F.size(entities.extract_udf("t")).alias("e")).collect()
    assert [r.n for r in rows] == [4, 0]


def test_statistics(spark):
    rows = spark.createDataFrame([(0, 10), (5, 10), (45, 50), (0, 0)], "k int, n int")
    got = [(round(r[0], 4), round(r[1], 4)) for r in rows.select(stats.wilson(F.col("k"), F.col("n"), False), stats.wilson(F.col("k"), F.col("n"), True)).collect()]
    assert got == [(0.0, 0.2775), (0.2366, 0.7634), (0.7864, 0.9565), (0.0, 1.0)]
    p = spark.createDataFrame([(8, 2), (5, 0), (0, 0)], "b int, c int").select(stats.mcnemar(F.col("b"), F.col("c"))).collect()
    assert [round(r[0], 6) for r in p] == [0.109375, 0.0625, 1.0]


def test_menus_codes_and_own_applications():
    assert canon("Note: dans Windows, ouvrez Fichier > Options > Courrier puis OK") == ["menu:fichier > options > courrier"] + []
    assert canon("-2999999999 et -2147024891") == ["err:0x80070005"]
    assert canon("A > un deux trois quatre cinq six sept > C") == []
    assert [e["canonical"] for e in entities.extract("Lancer Harmony RH", {"harmony": ["Harmony RH"]})] == ["app:harmony"]


def test_entity_table_function(spark):
    entities.register(spark)
    rows = spark.sql("SELECT d.id, e.canonical FROM VALUES (1, 'Microsoft Teams et KB893803'), (2, '') AS d(id, t), LATERAL entities(d.t) AS e").collect()
    assert sorted(map(tuple, rows)) == [(1, "app:teams"), (1, "update:KB893803")]


def test_masking_of_tickets(spark):
    from askwright.functions import masking as m

    texts = {
        "Bonjour Marie Dupont,\nLe poste plante.\nMerci d'avance,\nJean Martin\ntel 0612345678": "Bonjour [nom],\nLe poste plante.",
        "Cordialement": "Cordialement",
        "Hello M. Durand et Mme Petit!\nDe : Paul\nA : x@y.fr\nA : rien\nVoir @Jean Paul Ok le 01.10.2026 ou 06 12 34 56 78": "Hello [nom]!\nDe : [masqué]\nA : [masqué]\nA : rien\nVoir [mention] le 01.10.2026 ou [phone]",
        "Texte,\n bien à vous, Luc\nsuite": "Texte",
        "DUPONT Jean a appelé jean; Jean est là, JEAN non, Dupont": "[nom] a appelé jean; [nom] est là, JEAN non, [nom]",
    }
    rows = spark.createDataFrame([(t, ["DUPONT Jean", "EASYVISTA"]) for t in texts], "t string, p array<string>")
    assert {r.t: r.x for r in rows.select("t", m.clean_value(F.col("t"), people=F.col("p")).alias("x")).collect()} == texts
    stored = spark.createDataFrame([(1, "ok", "K", "x"), (2, "Écrire à a@b.fr", "K", "")], "id int, body string, code string, extra string")
    assert sorted(map(tuple, m.recleaned(stored, ["id"], ["body"], ["code"]).collect())) == [(1, "ok", "K", ""), (2, "Écrire à [email]", "K", "")]
    assert m.allowed_columns(["a", "b", "c"], ["a"], ["b"]) == (["a"], ["c"])
