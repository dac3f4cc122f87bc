"""Plain Python evaluation of a schema over a set of tuples, for one subject."""

from relgraph.schema.build import Arrow, Ref, SetOp


class Oracle:
    """Least fixpoint by rounds over all goals and objects; exclusions here are stratified."""

    def __init__(self, schema, tuples, subject, ids):
        self.schema, self.subject = schema, subject
        self.by = {}
        for t in tuples:
            self.by.setdefault(t[:3], []).append(t[3:])
        self.value = {(t, i, n): False for t, d in schema.definitions.items() for i in ids for n in [*d.relations, *d.permissions]}
        while True:
            before = dict(self.value)
            for k in self.value:
                self.value[k] = self._eval(k)
            if self.value == before:
                break

    def holds(self, t, i, n):
        return self.value.get((t, i, n), False)

    def _eval(self, key):
        t, i, n = key
        if self.subject == key:
            return True
        if self.schema.relation(t, n):
            return any(s == self.subject or s[1] == "*" and (s[0], "") == (self.subject[0], self.subject[2]) or s[2] and self.value.get(s, False) for s in self.by.get(key, ()))
        return self._expr(t, i, self.schema.permission(t, n).expr)

    def _expr(self, t, i, e):
        if isinstance(e, Ref):
            return self.value[t, i, e.name]
        if isinstance(e, Arrow):
            return any(self.value.get((s[0], s[1], e.target), False) for s in self.by.get((t, i, e.relation), ()))
        if isinstance(e, SetOp):
            parts = [self._expr(t, i, c) for c in e.children]
            return any(parts) if e.op == "union" else all(parts) if e.op == "intersection" else parts[0] and not parts[1]
        return False
