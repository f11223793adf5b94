"""hiresift: posting, applicant-document and funnel analytics as Spark DataFrame operators."""
