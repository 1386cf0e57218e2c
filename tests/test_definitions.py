import copy

import pytest

from chronofold.errors import DefinitionError
from chronofold.plans.definitions import Definitions, Draft, build_mode, changes, references, validate_definitions
from chronofold.queries import ORDER_DEFS, USER_DEFS


def changed(**edits):
    data = USER_DEFS.to_dict()
    for path, value in edits.items():
        at = data
        *parents, last = path.split("__")
        for p in parents:
            at = at[p]
        at[last] = value
    return validate_definitions(data)


def test_own_definitions_are_valid():
    assert USER_DEFS.validate().valid and ORDER_DEFS.validate().valid


@pytest.mark.parametrize(
    ("edit", "word"),
    [
        ({"entities__user__starts": "nowhere"}, "no state"),
        ({"entities__user__identity": {}}, "no identity"),
        ({"entities__user__properties__spent": {"type": "money"}}, "unknown type"),
        ({"entities__user__properties__spent": {"type": "number", "default": "x"}}, "not of type"),
        ({"entities__user__properties__spent": {"type": "number", "default": True}}, "not of type"),
        ({"entities__user__properties__valid_from": {"type": "string"}}, "system column"),
        ({"entities__user__properties__average": {"type": "number", "compute": "1 +"}}, "expected"),
        ({"entities__user__properties__average": {"type": "number", "compute": "f(1)"}}, "unknown function"),
        ({"entities__user__states__island": {}}, "cannot be reached"),
        ({"entities__user__states__lead": {"when": {"signup": {"effects": [{"transition": {"to": "customer"}}]}}}}, "'create'"),
        ({"entities__user__states__dormant": {"after": [{"type": "never", "threshold": "1d", "effects": []}]}}, "time rule"),
        ({"entities__user__states__dormant": {"after": [{"type": "inactivity", "threshold": "1w", "effects": []}]}}, "duration"),
        ({"entities__user__states__dormant": {"when": {"view": {"effects": [{"set": {"property": "none", "value": 1}}]}}}}, "undeclared"),
        ({"entities__user__states__dormant": {"when": {"view": {"effects": [{"set": {"property": "spent", "value": 1, "from": "event.k"}}]}}}}, "needs one of"),
        ({"entities__user__states__dormant": {"when": {"view": {"effects": [{"increment": {"property": "user"}}, {"explode": {}}]}}}}, "unknown effect"),
        ({"entities__user__relationships": [{"type": "a:b", "target": "user", "cardinality": "has_many"}]}, "reserved"),
        ({"entities__user__relationships": [{"type": "ab", "target": "ghost", "cardinality": "some"}]}, "cardinality"),
        ({"sources__web__timestamp": ""}, "empty"),
        ({"sources__web__events__view__hints": {}}, "no identity hints"),
        ({"sources__web__events__view__hints": {"user": ["k"]}}, "identifies no"),
        ({"sources__web__events__view__mappings": {"user": {"from": "a", "compute": "1"}}}, "both"),
        ({"schemas": {"signup": {"fields": {"user": {"type": "integer", "regex": "x"}}}}}, "'regex'"),
        ({"schemas": {"signup": {"fields": {"age": {"type": "integer", "required": True}}}}}, "requires 'age'"),
    ],
)
def test_mistakes_are_found(edit, word):
    found = changed(**edit)
    assert not found.valid and any(word in e for e in found.errors), found.errors


def test_relationships_need_a_way_back():
    data = ORDER_DEFS.to_dict()
    data["entities"]["customer"]["relationships"] = []
    assert any("no relationship back" in e for e in validate_definitions(data).errors)
    data = ORDER_DEFS.to_dict()
    data["entities"]["customer"]["relationships"][0]["cardinality"] = "many_to_many"
    assert any("does not go with" in e for e in validate_definitions(data).errors)


def test_warnings():
    data = USER_DEFS.to_dict()
    data["entities"]["user"]["properties"]["phone"] = {"type": "string", "treatment": "mask"}
    data["entities"]["user"]["states"]["customer"]["when"]["view"] = {"effects": [{"transition": {"to": "gone"}}]}
    data["entities"]["user"]["states"]["gone"] = {}
    text = " ".join(Definitions(data).validate().warnings)
    assert "without a sensitivity" in text and "dead end" in text and "no state handles" in text


def test_hashes_tell_what_changed():
    base = USER_DEFS.hashes()
    assert build_mode(base, base)[0] == "INCREMENTAL" and build_mode(None, base)[0] == "FULL"
    data = USER_DEFS.to_dict()
    data["sources"]["web"]["timestamp"] = "when"
    assert build_mode(base, Definitions(data).hashes())[0] == "FULL_RENORMALIZE"
    data = USER_DEFS.to_dict()
    data["entities"]["user"]["identity"]["user"]["normalize"] = "value"
    assert build_mode(base, Definitions(data).hashes())[0] == "FULL_WITH_IDENTITY_RESET"
    data = USER_DEFS.to_dict()
    data["entities"]["user"]["properties"]["x"] = {"type": "string"}
    assert build_mode(base, Definitions(data).hashes())[0] == "FULL"


def test_drafts_undo_what_breaks():
    draft = Draft(USER_DEFS, "v2")
    draft.add_property("user", "tier", type="string", default="free")
    before = copy.deepcopy(draft.data)
    for bad in (lambda: draft.add_property("user", "tier", type="string"), lambda: draft.add_property("user", "x", type="money"), lambda: draft.add_transition("user", "lead", "view", "mars"), lambda: draft.remove_state("user", "mars"), lambda: draft.add_property("ghost", "x", type="string")):
        with pytest.raises(DefinitionError):
            bad()
        assert draft.data == before
    draft.add_state("user", "gone")
    draft.add_transition("user", "dormant", "view", "gone", guard="event.k > 1")
    draft.add_handler("user", "gone", "signup", [{"transition": {"to": "lead"}}])
    draft.update_identity("user", mail={"match": "exact"})
    draft.remove_property("user", "errors")
    assert draft.validate().valid
    assert draft.diff()["modified"]["user"] == {"added_properties": ["tier"], "removed_properties": ["errors"], "added_states": ["gone"], "identity_changed": True}
    assert draft.impact()["build_mode"] == "FULL_WITH_IDENTITY_RESET"
    assert changes(None, USER_DEFS)["added"].keys() == {"user"}


def test_loading_from_folders(tmp_path):
    for folder, text in (("entities", "a: {starts: on, identity: {k: {}}, states: {on: {when: {e: {effects: [create]}}}}}"), ("sources", "s: {event_type: t, timestamp: at, events: {e: {mappings: {k: {from: k}}, hints: {a: [k]}}}}"), ("events", "e: {fields: {k: {type: string}}}")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "one.yaml").write_text(text)
    found = Definitions.from_directory(tmp_path)
    assert found.validate().valid and set(found.schemas) == {"e"}
    (tmp_path / "entities" / "two.yml").write_text("a: {}")
    with pytest.raises(DefinitionError):
        Definitions.from_directory(tmp_path)


def test_references():
    assert references("if entity.a > 1 then event.b else coalesce(x, entity.c[0])") == {("entity", "a"), ("event", "b"), ("x",), ("entity", "c")}
