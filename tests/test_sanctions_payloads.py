"""List payloads with list-specific field names, read from JSON and normalised."""
import json

from giftrisk.operators import screening as SC
from giftrisk.sources.sanctions import LIST_FIELDS, read_payloads


def test_payloads_from_json_normalise(spark, tmp_path):
    long_remark = "x" * 400
    docs = {
        "SDNs": [{"entityID": "1", "sdnName": "Kim Jong Un", "sdnType": "Individual",
                  "program": ["DPRK", "DPRK2"], "remarks": long_remark}],
        "altNames": [{"entityID": "2", "alternateName": "Kim Jong-un", "program": ["DPRK"], "remarks": ""}],
        "deniedPersons": [{"entityID": "3", "name": "Viktor Bout", "remarks": "r"}],
        "bisEntities": [{"EntityID": "4", "Name": "Acme Trading", "Remarks": "r"}],
        "euConsolidatedSanctionsList": [{"EntityID": "5", "Names": ["Bashar al-Assad", "B. Assad"],
                                         "Programs": ["SYRIA"], "OtherInfos": ["first info", "second"],
                                         "GroupType": "Person"}],
        "ukConsolidatedSanctionsList": [{"GroupID": "6", "Names": ["Semion Mogilevich"], "Programs": "RUSSIA",
                                         "OtherInfos": [], "GroupType": "Individual"}],
        "sectoralSanctions": [{"EntityID": "7", "Name": "Bank X", "Programs": "UKRAINE-EO13662", "Remarks": ""}],
    }
    for key, rows in docs.items():
        (tmp_path / f"{key}.json").write_text(json.dumps(rows))
    ents = {r["entity_id"]: r for r in SC.entities(read_payloads(spark, str(tmp_path))).collect()}
    assert set(ents) == {"1", "2", "3", "4", "5", "6", "7"}
    assert ents["1"]["list_name"] == "SDN" and ents["1"]["entity_type"] == "individual"
    assert len(ents["1"]["remarks"]) == 300 and sorted(ents["1"]["programs"]) == ["DPRK", "DPRK2"]
    assert ents["2"]["name"] == "Kim Jong-un" and ents["2"]["remarks"] == ""
    assert ents["4"]["entity_type"] == "organization" and ents["4"]["list_name"] == "BIS"
    assert ents["5"]["name"] == "Bashar al-Assad" and ents["5"]["remarks"] == "first info"
    assert ents["5"]["entity_type"] == "person"
    assert ents["6"]["programs"] == ["RUSSIA"] and ents["6"]["remarks"] == ""
    assert ents["7"]["list_name"] == "SSI" and ents["7"]["programs"] == ["UKRAINE-EO13662"]
    assert len(LIST_FIELDS) == 7


def test_every_script_is_screened_and_missing_lists_are_empty(spark, tmp_path):
    (tmp_path / "SDNs.json").write_text(json.dumps([
        {"entityID": "1", "sdnName": "", "Name": "Иван Петров", "country": "RU"}, {"entityID": "2", "sdnName": "محمد علي"},
        {"GroupID": "3", "sdnName": "Zoe Muller", "program": [], "Programs": ["P"]}]))
    ents = SC.entities(read_payloads(spark, str(tmp_path)))
    assert sorted(r.entity_id for r in ents.collect()) == ["1", "2", "3"]
    assert ents.where("entity_id = '3'").first().programs == ["P"]
    names = spark.createDataFrame([("a", "Иван  ПЕТРОВ"), ("b", "محمد علي"), ("c", "Zoë Müller"), ("d", "12345"), ("e", " "), ("f", "Ann Other")],
                                  "name_id string, name string")
    hits = SC.fuzzy_hits(names, ents)
    assert sorted((h.name_id, h.entity_id, h.match_score) for h in hits.collect()) == [("a", "1", 1.0), ("b", "2", 1.0), ("c", "3", 1.0)]
    status = {r.name_id: r.status for r in SC.screening_status(names, hits).collect()}
    assert status == {"a": "BLOCKED", "b": "BLOCKED", "c": "BLOCKED", "d": "UNREADABLE", "e": "INVALID", "f": "CLEAR"}
    assert {h.name_id for h in SC.fuzzy_hits(names, ents, country="ru").collect()} == {"a", "b", "c"}
    assert {h.name_id for h in SC.fuzzy_hits(names, ents, country="fr").collect()} == {"b", "c"}
    assert SC.fuzzy_hits(names, SC.entities({}, spark)).count() == 0
