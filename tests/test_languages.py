"""Stemmers and analyzers of languages on published cases."""

import pytest
from pyspark.sql import functions as F

from tesserae.functions import analysis as an
from tesserae.functions.stemmers import by_name

# Words and their published stems.
CASES = {
    "dutch": "lichaamsziek lichaamsziek lichamelijkheden licham lichtdoorlatende lichtdoorlat lichtende lichtend lichters lichter lichtgevoeligheid lichtgevoel lichtje lichtj lichtjes lichtjes lidstaten lidstat lidvereniging lidveren opglanzingen opglanz opgroeiplaats opgroeiplat opheffende ophef ophaal ophal",
    "brazilian": "boataria boat bobagem bobag bobagens bobagens bobear bob bobinhos bobinh bocadas boc boemia boem boiando boi quiabo quiab quicaram quic quickly quickly quimioterapia quimioterap quintuplicou quintuplic quiosque quiosqu",
    "french": "lances lanc habitable habit éléments élément captifs captif finissions fin souffrirent souffr rugissante rug anticonstitutionnellement anticonstitutionnel chevaux cheval majestueusement majestu",
    "spanish": "chicharrones chicharron torrentes torrent chilenos chilen cheque chequ toreándolo tor",
    "english": "consigned consign consistency consist consolatory consolatori knackeries knackeri knightly knight generously generous skies sky dying die cried cri ties tie gas gas this this hoping hope hopped hop happy happi by by say say proceed proceed nationalization nation controlling control agreement agreement",
    "italian": "abbandonata abbandon abbandonare abbandon pronunciamento pronunc propaga propag proprietà propriet pronti pront abbattimento abbatt",
    "russian": "вместе вмест силе сил электромагнитной электромагнитн энергии энерг имели имел представление представлен",
}


@pytest.mark.parametrize("name", CASES)
def test_published_stems(name):
    words = CASES[name].split()
    stem = by_name(name)
    assert [stem(w) for w in words[::2]] == words[1::2]
    assert all(isinstance(stem(w), str) for w in ("", "a", "é", "ss", "yy", "123", "漢字"))


def test_analyzers(spark):
    def terms(analyzer, text):
        return [x["term"] for x in spark.createDataFrame([(text,)], "t string").select(analyzer(F.col("t"))).first()[0]]

    assert terms(an.french_analyzer(), "le la chien les aux CHAT du des à cheval") == ["chien", "chat", "cheval"]
    assert terms(an.french_analyzer(exclude=("habitable",)), "habitable C3PO aujourd'hui") == ["habitable", "c3po", "aujourd'hui"]
    assert terms(an.dutch_analyzer(), "de fiets van het kind en lichamen") == ["fiets", "kinder", "licham"]
    assert terms(an.brazilian_analyzer(), "o Brasil e a boataria") == ["brasil", "boat"]
    assert terms(an.russian_analyzer(), "Вместе с тем о силе электромагнитной энергии имели представление еще 1000") == ["вмест", "сил", "электромагнитн", "энерг", "имел", "представлен", "1000"]
    assert terms(an.german_analyzer(), "der Tisch und die Häuser") == ["tisch", "haus"]
    assert terms(an.snowball_analyzer("spanish"), "los chicharrones") == ["los", "chicharron"]
    assert terms(an.czech_analyzer(), "Pokud mluvime o volnem") == ["mluvime", "volnem"]
