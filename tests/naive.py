"""An independent evaluator on Python sets: the oracle for rule programs."""

from corollary.functions.numeric import decide
from corollary.ir import Atom, Check, Const, Not, Var


def matches(atom, relation, env):
    for row in relation:
        new = dict(env)
        for t, v in zip(atom.args, row):
            if isinstance(t, Const):
                if t.value != v:
                    break
            elif new.setdefault(t.name, v) != v:
                break
        else:
            yield new


def value(t, env):
    return env[t.name] if isinstance(t, Var) else t.value


def holds(check, env):
    args = [value(t, env) for t in check.args]
    got = args[0] == args[1] if check.op == "equal" else decide(check.op, args)
    return got is not None and got != check.negated


def answers(body, model):
    envs = [{}]
    for x in sorted(body, key=lambda x: (not isinstance(x, Atom), isinstance(x, Not))):
        if isinstance(x, Atom):
            envs = [n for e in envs for n in matches(x, model.get(x.key, set()), e)]
        elif isinstance(x, Check):
            envs = [e for e in envs if holds(x, e)]
        else:
            envs = [e for e in envs if not any(True for _ in matches(x.atom, model.get(x.atom.key, set()), e))]
    return envs


def solve(rules, facts, levels):
    """The least model, stratum by stratum, by applying all rules until nothing is new."""
    model = {k: set(v) for k, v in facts.items()}
    for level in sorted(set(levels.values())):
        own = [r for r in rules if any(levels[h.relation] == level for h in r.heads)]
        while True:
            new = False
            for r in own:
                for env in answers(r.body, model):
                    for h in r.heads:
                        row = tuple(value(t, env) for t in h.args)
                        if row not in model.setdefault(h.key, set()):
                            model[h.key].add(row)
                            new = True
            if not new:
                break
    return model
