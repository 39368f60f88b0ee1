"""All queries over the project's tables, and the SQL they are checked against."""

from __future__ import annotations

from talkgrid.plans import conversation, coverage, rules, runs, sound, speakers, streams, text, vectors

SUBJECTS = [coverage, conversation, speakers, sound, rules, text, vectors, streams, runs]
QUERIES = {name: f for subject in SUBJECTS for name, f in subject.R.queries.items()}
SQL = {name: text for subject in SUBJECTS for name, text in subject.R.sql.items()}
