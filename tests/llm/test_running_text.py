import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newslake.llm import quality

FRENCH = ("Le ministre a parlé de « progrès » devant la presse, puis il a évoqué « la prudence » et enfin « la patience » "
          "avant de quitter la salle sans répondre aux questions des journalistes présents ce jour.")
GERMAN = ("Der Minister sprach von »Fortschritt« vor der Presse, erwähnte dann »Vorsicht« und schließlich »Geduld«, "
          "bevor er den Saal verließ, ohne auf die Fragen der Anwesenden einzugehen.")
POLICY = " ".join(["The company changed its privacy policy on Monday and asked readers to click here and share this with friends."]
                  + [f"Sentence number {i} reports on matter {i * 7} in town {i * 3}." for i in range(12)])


@pytest.mark.parametrize("line, fails", [
    (FRENCH, False), (GERMAN, False), ("Il a dit « oui », « non » et « peut-être ».", False), (POLICY, False), ("Una col·lecció, una il·lusió i una al·lusió.", False),
    ("The company changed its privacy policy on Monday.", False), ("Home » News » Sport » Results", True),
    ("Start • Über uns • Kontakt • Impressum", True), ("Home · News · Sport · Contact", True), ("a | b | c | d | e | f " * 20, True),
    ("Privacy Policy | Terms of Use", True), ("Subscribe to our newsletter", True), ("Please read our privacy policy.", True),
    ("Bitte lesen Sie unsere Datenschutzerklärung.", False), ("Unsere Datenschutzerklärung.", True), ("Alle Rechte vorbehalten.", True),
    ("Lire la suite", True), ("Politique de confidentialité", True), ("Todos los derechos reservados.", True), ("Política de privacidad", True),
    ("Leer más es un placer que se aprende despacio en casa.", False), ("Über uns", True), ("a·b c·d e·f g·h", False),
])
def test_rules_need_a_large_share_of_the_line(spark, checkpoints, line, fails):
    df = spark.createDataFrame([(line,)], "text string")
    row = df.select(quality.clean_lines(F.col("text"), F.regexp_count("text", F.lit(quality.SYMBOL))).alias("t")).first()
    assert (row.t != line) == fails


def test_stage_keeps_running_text(spark, checkpoints):
    rows = [(1, FRENCH + " " + GERMAN), (2, POLICY)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, df, "").collect()} == dict(rows)


def test_query_judges_as_the_stage_does(spark, checkpoints):
    rows = [(1, FRENCH + " " + GERMAN), (2, POLICY)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.kept and r.clean_chars == len(dict(rows)[r.doc_id]) for r in quality.report(df).collect())
    shared = [(3, FRENCH + "\n" + GERMAN + "\na·b·c·d | e\n| Start | Über uns | Kontakt |\nHier klicken und weiterlesen."), (4, POLICY + "\nx·y ·z· w • q ·")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows + shared)
    got = quality.report(spark.createDataFrame(rows + shared, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(quality.sql()).fetchall())
