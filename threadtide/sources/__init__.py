"""Reading and writing: raw landings, processed tables, dictionaries, events, reports."""
