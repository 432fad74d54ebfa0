"""The catalogue of diagram rules, in our own words, and documents in which each of them is found.

Element and attribute names are those of the modelling standard and of its common extensions (fixed values). `CASES` are
fragments of a process with the rules that they must show at each version, as golden rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrylake.functions.scalars import expression_severity, rewrite_expression
from ferrylake.operators.rules import ADDED, WHOLE, Catalogue, Edit, Node, Rule


def v(version: str) -> int:
    """major.minor as one number that orders 8.10 after 8.9."""
    major, minor = version.split(".")
    return int(major) * 1000 + int(minor)


EVENTS = ("startEvent", "endEvent", "boundaryEvent", "intermediateCatchEvent", "intermediateThrowEvent")
WORKERS = ("serviceTask", "sendTask", "scriptTask", "businessRuleTask")
ACTIVITIES = (*WORKERS, "task", "userTask", "manualTask", "receiveTask", "callActivity", "subProcess", "transaction", "adHocSubProcess")
LOOP = ("multiInstanceLoopCharacteristics",)
CONDITIONS = ("conditionExpression", "condition")
DELEGATES = ("class", "delegateExpression", "expression")
OPTIONS = {"always_default": False, "default_type": "worker", "keep_blank": False, "add_listener": False, "listener_type": "migrator"}
PARTS = {
    "reads": "reads {{ value }} and becomes {{ expression }}.",
    "call": "A method is called, which the target's language can't do.",
    "engine": "The engine's context is not there in the target.",
    "moved": "Attribute {{ attribute }} of {{ element }} was taken over.",
    "lost": "{{ element }} of {{ owner }} can't be taken over.",
    "no": "{{ element }} is not known to this version of the target.",
}

scripted = lambda n: n.a("language").isNotNull() & ~F.lower(n.a("language")).isin("feel", "juel")
plain = lambda n: n.a("language").isNull() | (F.lower(n.a("language")) == "juel")
feel = lambda n: F.lower(n.a("language")) == "feel"
calls = lambda n: n.value.rlike(r"^[$#]\{.*\}$") & ~engine(n)
engine = lambda n: F.regexp_replace(n.value, r"execution\.getVariable\([\"']\w+[\"']\)", "v").rlike(r"\bexecution\b")
own_script = lambda n: F.lower(n.a("scriptFormat")) == "feel"
decides = lambda n: n.a("decisionRef").isNotNull()


def implementation(n: Node) -> Column:
    return F.coalesce(n.a("class"), n.a("delegateExpression"), n.a("expression"))


def priority(n: Node) -> Column:
    return F.coalesce(n.a("taskPriority"), n.a("jobPriority"))


def worker_place(n: Node) -> Column:
    """Where a priority has an effect: the process, and tasks that become workers."""
    rules = (n.tag == "businessRuleTask") & ~decides(n)
    script = (n.tag == "scriptTask") & ~F.coalesce(own_script(n), F.lit(False))
    return (n.tag.isin("process", "serviceTask", "sendTask")) | rules | script


def expression_like(x: Column) -> Column:
    return x.rlike(r"^[$#]\{.*\}$")


def valid_priority(x: Column) -> Column:
    """A whole number of 32 bits, or an expression."""
    return expression_like(x) | F.coalesce(x.rlike(r"^-?\d+$") & x.try_cast("bigint").between(-(2**31), 2**31 - 1), F.lit(False))


def delegate_rules() -> list[Rule]:
    out = []
    for a in DELEGATES:
        typed = lambda n: n.worker != ""
        header = Edit("append", "header", None, (("key", lambda n, a=a: F.lit(a)), ("value", lambda n: n.value)))
        kind = Edit("append", "jobType", None, (("type", lambda n: n.worker),))
        default = Edit("append", "jobType", None, (("type", lambda n: F.lit(n.options["default_type"])),))
        strip = Edit("strip", a)
        off = (("keep_blank", False), ("always_default", False))
        places = ("serviceTask", "sendTask", "businessRuleTask")
        out += [
            Rule(f"delegate-{a}", places, "REVIEW", "{{ value }} became the job type {{ worker }}.", a, typed, options=off, edits=(strip, header, kind)),
            Rule(f"delegate-{a}-untyped", places, "TASK", "No job type could be made of {{ value }}. Give one.", a, lambda n: n.worker == "", options=off, edits=(strip, header)),
            Rule(f"delegate-{a}-default", places, "REVIEW", "{{ part.moved }} {{ value }} became the job type {{ default_type }}.", a, options=(("keep_blank", False), ("always_default", True)), edits=(strip, header, default)),
            Rule(f"delegate-{a}-blank", places, "TASK", "The job type of {{ value }} was left out as asked.", a, options=(("keep_blank", True),), edits=(strip, header)),
        ]
    return out


def condition_rules() -> list[Rule]:
    write = (Edit("text", value=lambda n: n.expression),)
    return [
        Rule("condition-own-language", CONDITIONS, "REVIEW", "The condition {{ part.reads }} Functions of your own are not carried over.", when=lambda n: feel(n) & n.text.isNotNull(), edits=(Edit("text", value=lambda n: F.concat(F.lit("="), n.text)),)),
        Rule("condition-rewritten", CONDITIONS, "REVIEW", "The condition {{ part.reads }}", when=lambda n: plain(n) & n.a("resource").isNull() & (n.graver == "REVIEW"), edits=write),
        Rule("condition-method", CONDITIONS, "TASK", "The condition {{ part.reads }} {{ part.call }}", when=lambda n: plain(n) & (n.graver == "TASK") & calls(n)),
        Rule("condition-engine", CONDITIONS, "TASK", "The condition {{ part.reads }} {{ part.engine }}", when=lambda n: plain(n) & (n.graver == "TASK") & engine(n)),
        Rule("condition-script", CONDITIONS, "TASK", "Write the {{ attr.language }} script {{ value }} as an expression.", when=lambda n: scripted(n) & n.text.isNotNull()),
        Rule("condition-resource", CONDITIONS, "TASK", "Write what {{ value }} holds as an expression.", "resource"),
    ]


def mapping_rules() -> list[Rule]:
    both = ("in", "out")
    source = lambda n: F.coalesce(n.a("source"), n.a("sourceExpression"))
    moved = lambda name: (Edit("drop"), Edit("append", name, None, (("source", lambda n: F.concat(F.lit("="), source(n))), ("target", lambda n: n.a("target"))), owner=True))
    every = lambda name: (Edit("drop"), Edit("set", name, lambda n: F.lit("true"), owner=True))
    in_all = lambda n: (n.a("variables") == "all") & (n.owner_tag == "callActivity")
    return [
        Rule("mapping-in", ("in",), "REVIEW", "Input {{ attr.target }} of {{ owner }} is mapped from {{ attr.source }}.", "source", edits=moved("input")),
        Rule("mapping-in-expression", ("in",), "graver", "Input {{ attr.target }} of {{ owner }} {{ part.reads }}", "sourceExpression"),
        Rule("mapping-out", ("out",), "REVIEW", "Output {{ attr.target }} of {{ owner }} is mapped from {{ attr.source }}.", "source", edits=moved("output")),
        Rule("mapping-all-in", ("in",), "INFO", "All variables of the parent go into {{ owner }}.", "variables", in_all, since=v("8.3"), edits=every("allFromParent")),
        Rule("mapping-all-in-old", ("in",), "INFO", "All variables go into {{ owner }} without saying so before 8.3.", "variables", in_all, until=v("8.3"), edits=(Edit("drop"),)),
        Rule("mapping-all-out", ("out",), "INFO", "All variables of the child come back from {{ owner }}.", "variables", in_all, edits=every("allFromChild")),
        Rule("mapping-business-key", both, "WARNING", "{{ part.lost }} The business key has to be a variable.", "businessKey", edits=(Edit("drop"),)),
        Rule("mapping-local", both, "TASK", "Only local variables of {{ owner }} were passed. Check its mappings.", "local", lambda n: n.value == "true"),
        Rule("mapping-signal", ("in",), "WARNING", "A signal can't take all variables.", "variables", lambda n: n.owner_tag == "signalEventDefinition", edits=(Edit("drop"),)),
        Rule("parameter", ("inputParameter", "outputParameter"), "graver", "Parameter {{ attr.name }} of {{ owner }} {{ part.reads }}", when=lambda n: n.text.isNotNull() & (F.size(n.kids) == 0)),
        Rule("parameter-nested", ("inputParameter", "outputParameter"), "WARNING", "Parameter {{ attr.name }} of {{ owner }} is no text or expression.", when=lambda n: n.has("list", "map")),
        Rule("parameter-script", ("inputParameter", "outputParameter"), "INFO", "Parameter {{ attr.name }} of {{ owner }} is a script.", when=lambda n: n.has("script")),
    ]


def listener_rules() -> list[Rule]:
    at = lambda *names: lambda n: n.a("event").isin(*names)
    listener = lambda name: (Edit("drop"), Edit("append", name, None, (("event", lambda n: n.a("event")), ("type", lambda n: F.coalesce(F.nullif(n_worker(n), F.lit("")), F.lit("")))), owner=True))

    def n_worker(n: Node) -> Column:
        return F.coalesce(F.regexp_extract(n.a("delegateExpression"), r"^[$#]\{(\w+)\}$", 1), implementation(n), F.lit(""))

    return [
        Rule("listener", ("executionListener",), "TASK", "The listener at {{ attr.event }} of {{ owner }} becomes a worker. Set its job type.", when=at("start", "end"), since=v("8.6"), edits=listener("listener")),
        Rule("listener-old", ("executionListener",), "WARNING", "{{ part.lost }} There are no listeners before 8.6.", when=at("start", "end"), until=v("8.6"), edits=(Edit("drop"),)),
        Rule("listener-take", ("executionListener",), "WARNING", "{{ part.lost }} Flows have no listeners.", when=at("take"), edits=(Edit("drop"),)),
        Rule("script-nested", ("script",), "WARNING", "{{ part.lost }} It reads {{ value }} in {{ attr.scriptFormat }}.", when=lambda n: n.parent.isin("executionListener", "taskListener"), edits=(Edit("drop"),)),
        Rule("task-listener", ("taskListener",), "TASK", "The listener at {{ attr.event }} of {{ owner }} becomes a worker. Set its job type.", when=lambda n: n.a("event") != "timeout", since=v("8.8"), edits=listener("taskListener")),
        Rule("task-listener-old", ("taskListener",), "WARNING", "{{ part.lost }} There are no such listeners before 8.8.", until=v("8.8"), edits=(Edit("drop"),)),
        Rule("task-listener-timeout", ("taskListener",), "WARNING", "{{ part.lost }} No listener waits for time-outs.", when=at("timeout"), since=v("8.8"), edits=(Edit("drop"),)),
        Rule("start-listener", ("startEvent",), "INFO", "{{ element }} got the listener {{ listener_type }}.", when=lambda n: ~F.exists(n.kids, lambda k: k.endswith("EventDefinition")) & (n.parent == "process"), options=(("add_listener", True),), priority=WHOLE, edits=(Edit("append", "listener", None, (("event", lambda n: F.lit("end")), ("type", lambda n: F.lit(n.options["listener_type"])))),)),
    ]


def script_rules() -> list[Rule]:
    s = ("scriptTask",)
    foreign = lambda n: n.a("scriptFormat").isNotNull() & ~F.coalesce(own_script(n), F.lit(False))
    header = lambda key, of: Edit("append", "header", None, (("key", lambda n: F.lit(key)), ("value", of)))
    return [
        Rule("script-format", s, "REVIEW", "The language {{ attr.scriptFormat }} is the header language now.", when=foreign, edits=(header("language", lambda n: n.a("scriptFormat")),)),
        Rule("script-worker", s, "REVIEW", "{{ name }} runs as a worker of type script.", when=foreign, edits=(Edit("append", "jobType", None, (("type", lambda n: F.lit("script")),)),)),
        Rule("script-text", ("script",), "REVIEW", "The script of {{ owner }} is the header script now.", when=lambda n: (n.parent == "scriptTask") & (F.lower(n.owner("scriptFormat")) != "feel"), edits=(Edit("drop"), Edit("append", "header", None, (("key", lambda n: F.lit("script")), ("value", lambda n: n.text)), owner=True))),
        Rule("script-own", ("script",), "INFO", "The script of {{ owner }} runs in the target.", when=lambda n: (n.parent == "scriptTask") & (F.lower(n.owner("scriptFormat")) == "feel"), since=v("8.2"), edits=(Edit("text", value=lambda n: F.concat(F.lit("="), n.text)),)),
        Rule("script-own-old", ("script",), "WARNING", "The target runs no scripts before 8.2, so that of {{ owner }} can't be taken over.", when=lambda n: (n.parent == "scriptTask") & (F.lower(n.owner("scriptFormat")) == "feel"), until=v("8.2")),
        Rule("script-resource", s, "REVIEW", "{{ part.moved }} It is the header resource now.", "resource", edits=(Edit("strip", "resource"), header("resource", lambda n: n.value))),
        Rule("result-header", WORKERS, "REVIEW", "{{ part.moved }} It is the header resultVariable now.", "resultVariable", lambda n: ~decides(n) & ~F.coalesce(own_script(n), F.lit(False)), edits=(Edit("strip", "resultVariable"), header("resultVariable", lambda n: n.value))),
        Rule("result-own", ("scriptTask", "businessRuleTask"), "INFO", "{{ part.moved }} The target sets it itself.", "resultVariable", lambda n: decides(n) | F.coalesce(own_script(n), F.lit(False))),
    ]


def binding_rules() -> list[Rule]:
    move = lambda old, new: (Edit("strip", old), Edit("set", new, lambda n: n.value))
    return [
        Rule("decision-binding", ("businessRuleTask",), "INFO", "The binding {{ value }} of the decision was taken over.", "decisionRefBinding", since=v("8.6"), edits=move("decisionRefBinding", "bindingType")),
        Rule("decision-tag", ("businessRuleTask",), "INFO", "The decision's tag {{ value }} was taken over.", "decisionRefVersionTag", since=v("8.6"), edits=move("decisionRefVersionTag", "versionTag")),
        Rule("called-binding", ("callActivity",), "INFO", "The binding {{ value }} of the called process was taken over.", "calledElementBinding", since=v("8.6"), edits=move("calledElementBinding", "bindingType")),
        Rule("called-tag", ("callActivity",), "INFO", "The called process's tag {{ value }} was taken over.", "calledElementVersionTag", since=v("8.6"), edits=move("calledElementVersionTag", "versionTag")),
        Rule("binding-old", ("businessRuleTask", "callActivity"), "WARNING", "{{ element }} is bound to the latest version before 8.6.", when=lambda n: F.coalesce(n.a("decisionRefBinding"), n.a("calledElementBinding")).isNotNull(), until=v("8.6"), edits=(Edit("strip", "decisionRefBinding"), Edit("strip", "calledElementBinding"))),
        Rule("form-binding", ("userTask", "startEvent"), "INFO", "The binding {{ value }} of the form was taken over.", "formRefBinding", since=v("8.6"), edits=move("formRefBinding", "bindingType")),
        Rule("form-key", ("userTask", "startEvent"), "TASK", "{{ part.moved }} Link a form of the target.", "formKey", edits=move("formKey", "externalReference")),
        Rule("version-tag", ("process", "decision"), "INFO", "The tag {{ value }} was taken over.", "versionTag", priority=WHOLE, edits=(Edit("append", "versionTag", None, (("value", lambda n: n.value),)),)),
        Rule("template", ACTIVITIES + EVENTS, "INFO", "The template {{ value }} was taken over.", "modelerTemplate"),
        Rule("template-version", ACTIVITIES + EVENTS, "INFO", "Version {{ value }} of the template was taken over.", "modelerTemplateVersion"),
    ]


def loop_rules() -> list[Rule]:
    return [
        Rule("collection", LOOP, "graver", "The collection of {{ owner }} {{ part.reads }}", "collection", edits=(Edit("strip", "collection"), Edit("set", "inputCollection", lambda n: n.expression))),
        Rule("collection-plain", LOOP, "TASK", "The results of {{ owner }} can be gathered by the target itself now.", "collection"),
        Rule("element-variable", LOOP, "INFO", "{{ part.moved }} It is the input element now.", "elementVariable", edits=(Edit("strip", "elementVariable"), Edit("set", "inputElement", lambda n: n.value))),
        Rule("cardinality", ("loopCardinality",), "WARNING", "The number {{ value }} of loops can't be fixed.", edits=(Edit("drop"),)),
        Rule("completion", ("completionCondition",), "graver", "Completion {{ part.reads }}", edits=(Edit("text", value=lambda n: n.expression),)),
    ]


def event_rules() -> list[Rule]:
    c = ("conditionalEventDefinition",)
    return [
        Rule("conditional-old", c, "WARNING", "{{ part.no }} It is from 8.9 on.", until=v("8.9")),
        Rule("conditional-names", c, "REVIEW", "The filter on the variable {{ value }} is gone; the target finds the condition's own.", "variableName", since=v("8.9"), edits=(Edit("strip", "variableName"),)),
        Rule("conditional-delete", c, "TASK", "{{ owner }} can't wait for deleted variables.", "variableEvents", lambda n: n.value.contains("delete"), since=v("8.9"), edits=(Edit("strip", "variableEvents"),)),
        Rule("conditional-id", c, "REVIEW", "A condition of {{ owner }} got an id.", when=lambda n: n.a("id").isNull(), since=v("8.9"), edits=(Edit("set", "id", lambda n: F.concat(F.lit("condition-"), n.owner("id"))),)),
        Rule("transaction", ("transaction",), "WARNING", "{{ part.no }}"),
        Rule("cancel", ("cancelEventDefinition",), "WARNING", "{{ part.no }}"),
        Rule("compensate", ("compensateEventDefinition",), "WARNING", "{{ part.no }} It is from 8.5 on.", until=v("8.5")),
        Rule("complex", ("complexGateway",), "WARNING", "{{ part.no }}"),
        Rule("escalation-old", ("escalationEventDefinition",), "WARNING", "{{ part.no }} It is from 8.2 on.", until=v("8.2")),
        Rule("inclusive-join", ("inclusiveGateway",), "WARNING", "{{ name }} joins flows, which an inclusive gateway can't.", when=lambda n: F.size(F.filter(n.kids, lambda k: k == "incoming")) > 1, until=v("8.6")),
        Rule("error-extension", ("errorEventDefinition",), "WARNING", "{{ part.lost }}", "expression", edits=(Edit("drop"),)),
        Rule("error-code", ("error",), "WARNING", "An error's code can't be an expression.", "errorCode", lambda n: expression_like(n.value)),
        Rule("escalation-code", ("escalation",), "WARNING", "An escalation's code can't be an expression.", "escalationCode", lambda n: expression_like(n.value)),
        Rule("correlation", ("message",), "TASK", "Give a correlation key if {{ value }} is caught.", "name"),
        Rule("timer-cycle", ("timeCycle",), "WARNING", "The cycle {{ value }} can't be a schedule here.", when=lambda n: n.text.rlike(r"^\S+(\s+\S+){4,}$"), until=v("8.1")),
    ]


def extension_rules() -> list[Rule]:
    cycle = r"^R(\d+)/PT?\w+$"
    drop = (Edit("drop"),)
    return [
        Rule("topic", ("serviceTask", "sendTask", "businessRuleTask", "messageEventDefinition"), "REVIEW", "{{ part.moved }} It is the job type now.", "topic", edits=(Edit("strip", "topic"), Edit("append", "jobType", None, (("type", lambda n: n.value),)))),
        *(Rule(f"removed-{a}", (), "INFO", "{{ attribute }} of {{ element }} is not used and was removed.", a, edits=(Edit("strip", a),)) for a in ("asyncBefore", "asyncAfter", "exclusive", "historyTimeToLive")),
        Rule("removed-type", ("serviceTask", "sendTask", "businessRuleTask", "messageEventDefinition"), "INFO", "{{ attribute }} of {{ element }} is not used and was removed.", "type", lambda n: n.value == "external", edits=(Edit("strip", "type"),)),
        Rule("starter", ("process",), "WARNING", "Users who may start {{ name }} can't be taken over.", "candidateStarterUsers", priority=WHOLE, edits=(Edit("strip", "candidateStarterUsers"),)),
        Rule("field", ("field",), "WARNING", "{{ part.lost }} Use inputs in place of fields.", edits=drop),
        Rule("form-data", ("formData",), "TASK", "{{ part.lost }} Link a form.", edits=drop),
        Rule("connector", ("connector",), "INFO", "The connector of {{ owner }} becomes a job."),
        Rule("connector-id", ("connectorId",), "REVIEW", "The connector {{ value }} is the job type of {{ owner }} now.", edits=(Edit("drop"), Edit("append", "jobType", None, (("type", lambda n: n.text),), owner=True))),
        Rule("property", ("property",), "INFO", "The property {{ attr.name }} of {{ owner }} was taken over."),
        Rule("retry-cycle", ("failedJobRetryTimeCycle",), "REVIEW", "The cycle {{ value }} of {{ owner }} became a number of retries.", when=lambda n: n.text.rlike(cycle), edits=(Edit("drop"), Edit("set", "retries", lambda n: F.regexp_extract(n.text, cycle, 1), owner=True))),
        Rule("retry-cycle-wrong", ("failedJobRetryTimeCycle",), "WARNING", "{{ part.lost }} The cycle {{ value }} is not well-formed.", when=lambda n: ~n.text.rlike(cycle), edits=drop),
    ]


def priority_rules() -> list[Rule]:
    on = lambda test: lambda n: priority(n).isNotNull() & test(n)
    fits = lambda n: worker_place(n) & valid_priority(priority(n))
    strip = (Edit("strip", "jobPriority"), Edit("strip", "taskPriority"))
    write = Edit("append", "priority", None, (("value", lambda n: F.when(expression_like(priority(n)), rewrite_expression(priority(n))).otherwise(priority(n))),))
    return [
        Rule("priority-merged", (), "REVIEW", "Both scales of priority are one now. Check that the numbers of {{ name }} still fit.", when=on(fits), since=v("8.10"), edits=(*strip, write), priority=ADDED),
        Rule("priority-both", (), "REVIEW", "{{ name }} has two priorities; {{ attr.taskPriority }} counts and {{ attr.jobPriority }} doesn't.", "taskPriority", lambda n: n.a("jobPriority").isNotNull() & worker_place(n), since=v("8.10"), priority=ADDED),
        Rule("priority-expression", (), "REVIEW", "The priority of {{ name }} became an expression of the target.", when=on(lambda n: fits(n) & expression_like(priority(n)) & (expression_severity(priority(n)) == "REVIEW")), since=v("8.10"), priority=ADDED),
        Rule("priority-call", (), "TASK", "The priority of {{ name }} can't be an expression of the target.", when=on(lambda n: fits(n) & expression_like(priority(n)) & (expression_severity(priority(n)) == "TASK")), since=v("8.10"), priority=ADDED),
        Rule("priority-invalid", (), "TASK", "The priority of {{ name }} is no whole number of 32 bits and no expression. It was left out.", when=on(lambda n: worker_place(n) & ~valid_priority(priority(n))), since=v("8.10"), edits=strip, priority=ADDED),
        Rule("priority-place", (), "WARNING", "Only tasks of workers and processes have a priority, so that of {{ name }} was left out.", when=on(lambda n: ~worker_place(n)), since=v("8.10"), edits=strip, priority=ADDED),
        Rule("priority-old", (), "WARNING", "There is no priority before 8.10, so that of {{ name }} was left out.", when=on(lambda n: F.lit(True)), until=v("8.10"), edits=strip, priority=ADDED),
    ]


CATALOGUE = Catalogue(
    [*condition_rules(), *mapping_rules(), *listener_rules(), *delegate_rules(), *script_rules(), *binding_rules(), *loop_rules(), *event_rules(), *extension_rules(), *priority_rules()],
    PARTS,
    OPTIONS,
)

VERSIONS = ("8.0", "8.2", "8.5", "8.7", "8.9", "8.10")
#: What a fragment shows: rules at all versions, then those from a version on and those before it.
CASES: tuple[tuple[str, str], ...] = (
    ('<callActivity id="c" calledElementBinding="deployment" calledElementVersionTag="1"><extensionElements><in source="a" target="b"/><in sourceExpression="${x.y()}" target="d"/><out source="b" target="a"/><in variables="all"/><out variables="all"/><in businessKey="#{k}"/><in source="z" target="z" local="true"/></extensionElements></callActivity>',
     "mapping-in mapping-in-expression mapping-out mapping-all-in>=8.3 mapping-all-in-old<8.3 mapping-all-out mapping-business-key mapping-in mapping-local called-binding>=8.6 called-tag>=8.6 binding-old<8.6"),
    ('<sequenceFlow id="f"><conditionExpression>${a == 1 &amp;&amp; b}</conditionExpression></sequenceFlow><sequenceFlow id="g"><conditionExpression language="feel">a = 1</conditionExpression></sequenceFlow><sequenceFlow id="h"><conditionExpression>${a.b()}</conditionExpression></sequenceFlow><sequenceFlow id="i"><conditionExpression>${execution.id}</conditionExpression></sequenceFlow><sequenceFlow id="j"><conditionExpression language="groovy">a</conditionExpression></sequenceFlow><sequenceFlow id="k"><conditionExpression language="groovy" resource="r.groovy"/></sequenceFlow>',
     "condition-rewritten condition-own-language condition-method condition-engine condition-script condition-resource"),
    ('<serviceTask id="s" class="org.a.Send" resultVariable="r" asyncBefore="true" asyncAfter="true" exclusive="false" jobPriority="90"><extensionElements><executionListener event="start" class="org.a.L"/><executionListener event="end"><script scriptFormat="groovy">x</script></executionListener><inputOutput><inputParameter name="p">${a}</inputParameter><inputParameter name="q"><list/></inputParameter><inputParameter name="r"><script scriptFormat="groovy">y</script></inputParameter></inputOutput><field name="f"/><failedJobRetryTimeCycle>R3/PT5M</failedJobRetryTimeCycle></extensionElements></serviceTask>',
     "delegate-class result-header removed-asyncBefore removed-asyncAfter removed-exclusive priority-merged>=8.10 priority-old<8.10 listener>=8.6 listener>=8.6 listener-old<8.6 listener-old<8.6 script-nested parameter parameter-nested parameter-script field retry-cycle"),
    ('<userTask id="u" formKey="k" formRefBinding="latest" modelerTemplate="t" modelerTemplateVersion="2" taskPriority="5"><extensionElements><taskListener event="create" class="org.a.T"/><taskListener event="timeout" class="org.a.T"/><formData/><failedJobRetryTimeCycle>often</failedJobRetryTimeCycle></extensionElements></userTask><sequenceFlow id="t"><extensionElements><executionListener event="take" class="a"/></extensionElements></sequenceFlow>',
     "form-key form-binding>=8.6 template template-version priority-place>=8.10 priority-old<8.10 task-listener>=8.8 task-listener-old<8.8 task-listener-timeout>=8.8 task-listener-old<8.8 form-data retry-cycle-wrong listener-take"),
    ('<scriptTask id="g" scriptFormat="groovy" resultVariable="v" jobPriority="${p}"><script>1 + 1</script></scriptTask><scriptTask id="o" scriptFormat="feel" resultVariable="w" jobPriority="4"><script>a + b</script></scriptTask><scriptTask id="e" scriptFormat="groovy" resource="s.groovy"/>',
     "script-format script-worker result-header priority-merged>=8.10 priority-expression>=8.10 priority-old<8.10 script-text result-own priority-place>=8.10 priority-old<8.10 script-own>=8.2 script-own-old<8.2 script-format script-worker script-resource"),
    ('<businessRuleTask id="b" decisionRef="d" decisionRefBinding="versionTag" decisionRefVersionTag="1.0" resultVariable="x"/><sendTask id="n" delegateExpression="${bean}" jobPriority="abc"/><sendTask id="m" expression="${a.b()}" jobPriority="${o.p()}" taskPriority="7"/><serviceTask id="q" expression="${1}"/><serviceTask id="w" type="external" topic="t" jobPriority="9999999999"/><serviceTask id="z" class=""/><serviceTask id="y" delegateExpression="${}"/>',
     "decision-binding>=8.6 decision-tag>=8.6 binding-old<8.6 result-own delegate-delegateExpression priority-invalid>=8.10 priority-old<8.10 delegate-expression priority-merged>=8.10 priority-both>=8.10 priority-old<8.10 delegate-expression topic removed-type priority-invalid>=8.10 priority-old<8.10 delegate-class-untyped delegate-delegateExpression-untyped"),
    ('<task id="l"><multiInstanceLoopCharacteristics collection="${items}" elementVariable="i"><loopCardinality>3</loopCardinality><completionCondition>${n.size()}</completionCondition></multiInstanceLoopCharacteristics></task><startEvent id="c1"><conditionalEventDefinition variableName="v" variableEvents="create,delete"><condition language="feel">v = 1</condition></conditionalEventDefinition></startEvent>',
     "collection collection-plain element-variable cardinality completion conditional-old<8.9 conditional-names>=8.9 conditional-delete>=8.9 conditional-id>=8.9 condition-own-language"),
    ('<transaction id="t"><endEvent id="e"><cancelEventDefinition/></endEvent></transaction><boundaryEvent id="x"><compensateEventDefinition/></boundaryEvent><complexGateway id="y" jobPriority="1"/><inclusiveGateway id="j"><incoming>1</incoming><incoming>2</incoming></inclusiveGateway><endEvent id="q"><escalationEventDefinition/></endEvent><endEvent id="r"><errorEventDefinition expression="${e}"/></endEvent><error errorCode="${c}"/><escalation escalationCode="${c}"/><message name="m"/><startEvent id="s"><timerEventDefinition><timeCycle>0 0 9 * * ?</timeCycle></timerEventDefinition></startEvent><intermediateThrowEvent id="k"><signalEventDefinition><extensionElements><in variables="all"/></extensionElements></signalEventDefinition></intermediateThrowEvent>',
     "transaction cancel compensate<8.5 complex priority-place>=8.10 priority-old<8.10 inclusive-join<8.6 escalation-old<8.2 error-extension error-code escalation-code correlation timer-cycle<8.1 mapping-signal"),
    ('<serviceTask id="p"><extensionElements><connector><connectorId>http</connectorId></connector><properties><property name="a" value="b"/></properties></extensionElements></serviceTask><startEvent id="s"/><serviceTask id="r" expression="${}" jobPriority="${o.p()}"/>',
     "connector connector-id property delegate-expression-untyped priority-merged>=8.10 priority-call>=8.10 priority-old<8.10"),
)
#: Attributes of the process around each fragment and what they show.
PROCESS = ('versionTag="2" historyTimeToLive="P1D" candidateStarterUsers="a"', "version-tag removed-historyTimeToLive starter")
#: Rules that only options bring: how often in which fragment.
BY_OPTION = (
    ({"always_default": True, "default_type": "all"}, {"delegate-class-default": {2: 1, 5: 1}, "delegate-delegateExpression-default": {5: 2}, "delegate-expression-default": {5: 2, 8: 1}}),
    ({"keep_blank": True}, {"delegate-class-blank": {2: 1, 5: 1}, "delegate-delegateExpression-blank": {5: 2}, "delegate-expression-blank": {5: 2, 8: 1}}),
    ({"add_listener": True}, {"start-listener": {8: 1}}),
)


def expected(fragment: int, version: str) -> list[str]:
    """The rules that a fragment shows at a version, from its golden line."""
    out = []
    for word in f"{CASES[fragment][1]} {PROCESS[1]}".split():
        if ">=" in word:
            rule, at = word.split(">=")
            out += [rule] * (v(version) >= v(at))
        elif "<" in word:
            rule, at = word.split("<")
            out += [rule] * (v(version) < v(at))
        else:
            out.append(word)
    return sorted(out)


def document(number: Column, name: Column) -> Column:
    """A process whose fragment is chosen by `number`, with a name of its own."""
    parts = F.array(*(F.lit(x) for x, _ in CASES))
    clean = F.regexp_replace(name, r"[&<>\"]", " ")
    return F.concat(F.lit(f'<process id="p" {PROCESS[0]} name="'), clean, F.lit('">'), parts[F.pmod(number, F.lit(len(CASES))).cast("int")], F.lit("</process>"))
