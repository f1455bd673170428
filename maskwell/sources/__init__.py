"""Tables in and out: messages, spans, audit rows, rules and the encrypted vault."""
