"""A session walked one answer at a time, as the yardstick for the Spark folds."""

LIMITS = {"Easy": 5, "Medium": 8, "Hard": 5}


FULL = LIMITS["Medium"] * 10
# What the end of a phase leads to, and what it says: by level and whether 70 % of a full Medium phase were reached.
ENDS = {
    ("Easy", False): ("Medium", "Easy round complete. Advancing to Medium."),
    ("Easy", True): ("Medium", "Easy round complete. Advancing to Medium."),
    ("Medium", True): ("Hard", "Medium round complete ({pct:.0f}%). Advancing to Hard."),
    ("Medium", False): (None, "Medium round complete ({pct:.0f}%). Below threshold (70%). Interview concluded."),
    ("Hard", False): (None, "Hard round complete. Interview finished!"),
    ("Hard", True): (None, "Hard round complete. Interview finished!"),
}


class Session:
    def __init__(self, pool=None):
        self.length = {k: min(n, (pool or LIMITS)[k]) for k, n in LIMITS.items()}
        self.level, self.marks = "Easy", []  # marks of the phase
        self.total = self.possible = 0
        self.turns, self.message, self.done, self.quit = [], "", False, False

    @property
    def asked(self):
        """Answers of the phase; a phase that is over counts as full."""
        return LIMITS[self.level] if self.done else len(self.marks)

    def settle(self):
        """Leave phases that have nothing (more) to ask; the last one left gives the message."""
        while not self.done and len(self.marks) == self.length[self.level]:
            reached = sum(self.marks)
            following, text = ENDS[self.level, reached >= 0.7 * FULL]
            self.message = text.format(pct=reached / FULL * 100)
            if following is None:
                self.done = True
            else:
                self.level, self.marks = following, []

    def answer(self, seq, score):
        if self.done:
            return False
        self.message = ""
        level = self.level
        self.marks.append(score)
        q_num = len(self.marks)
        self.total += score
        self.possible += 10
        self.settle()
        self.turns.append((seq, level, q_num, self.total, self.possible, self.message, self.level,
                           None if self.done else len(self.marks) + 1, self.done))
        return True

    def fold(self):
        pct = self.total / self.possible * 100 if self.possible else 0.0
        verdict = "STRONG HIRE" if pct >= 80 else "LEANING HIRE" if pct >= 60 else "NO HIRE"
        return (self.level, len(self.turns), self.total, self.possible, round(pct, 1), self.done,
                verdict if self.done else None)


    def ended_fold(self):
        """The fold where a session may quit: ``ended`` before the verdict, on what was asked."""
        *state, pct, done, _ = self.fold()
        ended = done or self.quit
        exact = self.total / self.possible * 100 if self.possible else 0.0
        verdict = "STRONG HIRE" if exact >= 80 else "LEANING HIRE" if exact >= 60 else "NO HIRE"
        return (*state, pct, done, ended, verdict if ended and self.turns else None)


def run(log, pools=None, quit_ends=False, on_empty_easy="reject", blank="skip"):
    """Sessions by key and refused (session, seq) out of rows (session, seq, score, answer)."""
    sessions, refused, gone = {}, [], set()
    for key, seq, score, answer in sorted(log):
        if key in gone or (blank == "skip" and answer.strip() == ""):
            continue
        if answer.strip() == "":
            score = 0
        pool = None if pools is None else pools.get(key)
        if pools is not None and (pool is None or (pool["Easy"] == 0 and on_empty_easy == "reject")):
            continue
        if key not in sessions:
            sessions[key] = Session(pool)
            if pools is not None:
                sessions[key].settle()
                sessions[key].message = ""
        if quit_ends and answer.strip().lower() == "quit":
            gone.add(key)
            sessions[key].quit = True
        elif not sessions[key].answer(seq, score):
            refused.append((key, seq))
    return {k: s for k, s in sessions.items() if s.turns or s.quit}, refused
