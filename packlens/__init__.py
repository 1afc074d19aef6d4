"""packlens: Spark jobs for document question answering audits and battery ageing data."""
