"""The question language: validated plan dictionaries, run as one DataFrame each."""
