"""granary: document-corpus analytics and evidence grounding as Spark plans."""
