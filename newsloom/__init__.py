"""PySpark jobs for news-coverage analytics: sources, stories, briefs, revisions, audits."""
