"""Query catalog (one entry per operator), the staged retention job, and
SQL texts of the fixture views used by the independent oracle."""
