"""Single-line faults in traces, with the verifier's label, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics as M
from . import text as X

# Wording of faults, labels and corrections; kinds of cases.
RATING_LINE = rf"(?i)^Candidate\s+({X.UCI}):\s*({M.SCORE});\s*Bucket:\s*(.+?)\s*$"
WRONG_BUCKET, OTHER_WRONG_BUCKET = "decisive", "equal"
BALANCE, WRONG_BALANCE = "Balance:", "Balance: White is ahead by 99."
SOUND = ("sound", "none", "none", "none")
CASES = {
    "7.8_candidate_ratings": (
        ("best", "candidate_rating_wrong_best", "hard"), ("bucket", "candidate_rating_wrong_bucket", "hard"),
        ("sign", "candidate_rating_wrong_eval", "hard"), ("malformed", "candidate_rating_malformed_line", "easy"),
    ),
    "1.18_material_balance_trace": (("balance", "material_balance_wrong_eval", "easy"),),
    "2.10_ray_walk": (("Moves from rays:", "ray_walk_wrong_move_set", "medium"),),
    "2.11_legal_filter_trace": (("All legal moves:", "legal_filter_wrong_move_set", "medium"),),
}
SOUND_KINDS = {"7.8_candidate_ratings": "candidate_rating_sound", "1.18_material_balance_trace": "material_balance_sound", "2.10_ray_walk": "ray_walk_sound", "2.11_legal_filter_trace": "legal_filter_sound"}
# Fixed values end.


def _let(value: Column, body) -> Column:
    """body(value), worked out once however often body names it; lambdas of functions
    on arrays would work out an expression again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fault(lines: Column, at: Column, new: Column, error: str, correction: Column) -> Column:
    """struct(text, faulty_line, error_type, correction) of the lines with line ``at``
    (from 1; 0 or null: no such line) replaced; null where nothing changes."""
    def told(x: Column) -> Column:
        changed = F.transform(lines, lambda y, i: F.when(i + 1 == x["at"], x["new"]).otherwise(y))
        struct = lambda c: F.struct(F.array_join(c, "\n").alias("text"), x["at"].cast("int").alias("faulty_line"), F.lit(error).alias("error_type"), x["correction"].alias("correction"))
        return _let(changed, lambda c: F.when((F.coalesce(x["at"], F.lit(0)) > 0) & (c != lines), struct(c)))

    return _let(F.struct(at.alias("at"), new.alias("new"), correction.alias("correction")), told)


def _at_first(text: Column, holds, fault) -> Column:
    """fault(lines, place, line) of the first line that holds."""
    def placed(own: Column) -> Column:
        return _let(F.array_position(F.transform(own, holds), True), lambda at: _let(F.get(own, (at - 1).cast("int")), lambda line: fault(own, at, line)))

    return _let(X.lines(text), placed)


def _part(line: Column, i: int) -> Column:
    return F.regexp_extract(line, RATING_LINE, i)


def wrong_best(text: Column) -> Column:
    """Another candidate, the first, in the last line "Best: ..."."""
    def fault(own: Column, best: Column) -> Column:
        named = F.filter(F.transform(own, lambda x: F.lower(F.regexp_extract(x, rf"(?i)^Candidate\s+({X.UCI}):", 1))), lambda m: (m != "") & (m != best))
        return _let(named, lambda n: _fault(own, F.when((F.size(own) >= 6) & (best != "") & (F.size(n) > 0), F.size(own)), F.concat(F.lit("Best: "), F.get(n, F.lit(0))), "wrong_best", F.concat(F.lit("Best should be "), best, F.lit("."))))

    return _let(X.lines(text), lambda own: _let(F.lower(F.regexp_extract(F.try_element_at(own, F.lit(-1)), M.CANDIDATE_BEST, 1)), lambda best: fault(own, best)))


def wrong_bucket(text: Column) -> Column:
    """The first candidate's bucket replaced."""
    def fault(own: Column, at: Column, line: Column) -> Column:
        uci, bucket = F.lower(_part(line, 1)), X.squeeze(F.lower(_part(line, 3)))
        other = F.when(bucket == WRONG_BUCKET, OTHER_WRONG_BUCKET).otherwise(WRONG_BUCKET)
        new = F.concat(F.lit("Candidate "), uci, F.lit(": "), _part(line, 2), F.lit("; Bucket: "), other)
        return _fault(own, at, new, "wrong_bucket", F.concat(F.lit("Candidate "), uci, F.lit(" bucket should be "), bucket, F.lit(".")))

    return _at_first(text, lambda x: x.rlike(RATING_LINE), fault)


def flipped_sign(text: Column) -> Column:
    """The first candidate's score in centipawns, if not zero, with its sign changed."""
    def fault(own: Column, at: Column, line: Column) -> Column:
        uci, score = F.lower(_part(line, 1)), _part(line, 2)
        new = F.concat(F.lit("Candidate "), uci, F.lit(": "), F.translate(score, "+-", "-+"), F.lit("; Bucket: "), _part(line, 3))
        return _fault(own, at, new, "wrong_eval", F.concat(F.lit("Candidate "), uci, F.lit(" score should be "), score, F.lit(".")))

    return _at_first(text, lambda x: x.rlike(r"(?i)^Candidate\s+" + X.UCI + r":\s*[+-]0*[1-9]\d*cp;\s*Bucket:\s*.+$"), fault)


def malformed(text: Column) -> Column:
    """The first candidate's line without the colon after its move."""
    def fault(own: Column, at: Column, line: Column) -> Column:
        new = F.concat(F.lit("Candidate "), F.lower(_part(line, 1)), F.lit(" "), _part(line, 2), F.lit("; Bucket: "), _part(line, 3))
        return _fault(own, at, new, "malformed_line", F.concat(F.lit("Line should be `"), line, F.lit("`.")))

    return _at_first(text, lambda x: x.rlike(RATING_LINE), fault)


def _prefixed(text: Column, prefix: str, new: str, error: str) -> Column:
    return _at_first(text, lambda x: x.startswith(prefix), lambda own, at, line: _fault(own, at, F.lit(new), error, F.concat(F.lit("Line should be `"), line, F.lit("`."))))


def wrong_balance(text: Column) -> Column:
    return _prefixed(text, BALANCE, WRONG_BALANCE, "wrong_eval")


def wrong_final_set(text: Column, prefix: str) -> Column:
    """No moves in the first line with that beginning."""
    return _prefixed(text, prefix, f"{prefix} none", "wrong_move_set")


def step_answer(verdict: Column, line: Column, error: Column, correction: Column) -> Column:
    names = [n for n, _ in M.STEP_LINES]
    return F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), v) for n, v in zip(names, (verdict, line, error, correction), strict=True)])


def verification_cases(rows: DataFrame, task: str = "task", answer: str = "answer") -> DataFrame:
    """The rows of traces that can be verified, once for each fault that can be put into
    the trace and once as it is: with displayed_trace, verification_trace (numbered),
    corruption_kind, difficulty, verification_verdict, faulty_line, error_type,
    correction and expected_answer. A trace no fault fits is left out, unless it rates
    candidates."""
    own = F.col(answer)
    makers = {"best": wrong_best, "bucket": wrong_bucket, "sign": flipped_sign, "malformed": malformed, "balance": wrong_balance}
    case = "struct<text:string,verdict:string,line:string,error:string,correction:string,kind:string,difficulty:string>"
    found = F.array().cast(f"array<{case}>")
    for name, kinds in CASES.items():
        made = []
        for how, kind, difficulty in kinds:
            fault = makers[how](own) if how in makers else wrong_final_set(own, how)
            made.append(F.struct(fault.alias("fault"), F.lit(kind).alias("kind"), F.lit(difficulty).alias("difficulty")))
        verdict, line, error, correction = (F.lit(x) for x in SOUND)
        sound = F.struct(own.alias("text"), verdict.alias("verdict"), line.alias("line"), error.alias("error"), correction.alias("correction"), F.lit(SOUND_KINDS[name]).alias("kind"), F.lit("sound").alias("difficulty"))
        broken = F.transform(F.filter(F.array(*made), lambda x: x["fault"].isNotNull()), lambda x: F.struct(
            x["fault"]["text"].alias("text"), F.lit("broken").alias("verdict"), x["fault"]["faulty_line"].cast("string").alias("line"), x["fault"]["error_type"].alias("error"),
            x["fault"]["correction"].alias("correction"), x["kind"].alias("kind"), x["difficulty"].alias("difficulty"),
        ))
        # the whole trace goes last; alone, it stays only where it rates candidates
        least = 1 if name == "7.8_candidate_ratings" else 2
        cases = F.filter(F.array(F.concat(broken, F.array(sound))), lambda x: F.size(x) >= least)  # noqa: B023
        cases = F.coalesce(F.get(cases, F.lit(0)), F.array().cast(f"array<{case}>"))
        found = F.when(F.col(task) == name, cases).otherwise(found)
    each = rows.withColumn("_case", F.explode(found))
    c = lambda f: F.col(f"_case.{f}")
    return each.select(
        *[x for x in rows.columns], c("text").alias("displayed_trace"), M.number_lines(c("text")).alias("verification_trace"), c("kind").alias("corruption_kind"),
        c("difficulty").alias("difficulty"), c("verdict").alias("verification_verdict"), c("line").alias("faulty_line"), c("error").alias("error_type"), c("correction").alias("correction"),
        step_answer(c("verdict"), c("line"), c("error"), c("correction")).alias("expected_answer"),
    )
