"""Thirty transcripts as found in the wild, written before the model that is tested on them was last changed, in forms that
its training transcripts don't have all of."""

U, A, S = "user", "assistant", "system"
FOREIGN = [
    ([(U, "Hi there"), (A, "Hello! How can I help?")], "User: Hi there\nAssistant: Hello! How can I help?"),
    ([(A, "ok\nNote: careful\nWarning: x")], "Assistant: ok\nNote: careful\nWarning: x"),
    ([(U, "a"), (A, "b")], "Human: a <|end|>\nAI: b"),
    ([(U, "what is it?"), (A, "this")], "<user>what is it?</user>\n<assistant>this</assistant>"),
    ([(U, "how?"), (A, "so")], "### User\nhow?\n### Assistant\nso"),
    ([(U, "hi"), (A, "hello"), (U, "bye")], "10:01 alice> hi\n10:02 bob> hello\n10:03 alice> bye"),
    ([(U, "how old?"), (A, "ten")], "You said:\nhow old?\nChatGPT said:\nten"),
    ([(U, "bonjour"), (A, "salut"), (U, "ça va ?")], "Utilisateur : bonjour\nAssistant : salut\nUtilisateur : ça va ?"),
    ([(U, "hi"), (A, "hello")], "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>"),
    ([(S, "You are terse."), (U, "Name a river."), (A, "Nile.")], "<|im_start|>system\nYou are terse.<|im_end|>\n<|im_start|>user\nName a river.<|im_end|>\n<|im_start|>assistant\nNile.<|im_end|>"),
    ([(U, "What is the boiling point of water?"), (A, "100 degrees at sea level.")], "Q: What is the boiling point of water?\nA: 100 degrees at sea level."),
    ([(U, "My printer is jammed."), (A, "Please open the tray.\nThen pull gently."), (U, "Done, thanks.")], "Customer: My printer is jammed.\nAgent: Please open the tray.\nThen pull gently.\nCustomer: Done, thanks."),
    ([(U, "write code"), (A, "```\nfor x in y:\n    print(x)\n```"), (U, "shorter")], "**User:** write code\n**Assistant:** ```\nfor x in y:\n    print(x)\n```\n**User:** shorter"),
    ([(U, "List fruits"), (A, "Here:\n- apple: red\n- pear: green\n\nEnjoy"), (U, "more")], "USER: List fruits\nASSISTANT: Here:\n- apple: red\n- pear: green\n\nEnjoy\nUSER: more"),
    ([(U, "hey"), (A, "yo")], "[user] hey\n[assistant] yo"),
    ([(U, "I can't sleep."), (A, "Since when?"), (U, "A week."), (A, "Any stress?")], "Patient: I can't sleep.\nDoctor: Since when?\nPatient: A week.\nDoctor: Any stress?"),
    ([(S, "Always answer in French."), (U, "Hello"), (A, "Bonjour")], "System: Always answer in French.\n\nUser: Hello\n\nAssistant: Bonjour"),
    ([(U, "Where are you from?"), (A, "From Ghent."), (U, "Nice!")], "Interviewer: Where are you from?\nGuest: From Ghent.\nInterviewer: Nice!"),
    ([(U, "1+1?"), (A, "2"), (U, "2+2?"), (A, "4")], "Question: 1+1?\nAnswer: 2\nQuestion: 2+2?\nAnswer: 4"),
    ([(U, "See http://a.b/c: is it down?"), (A, "Error: 404\nYes, it is.")], "User: See http://a.b/c: is it down?\nAssistant: Error: 404\nYes, it is."),
    ([(U, "morning"), (A, "morning!"), (U, "coffee?"), (A, "sure")], "[09:15] Tom: morning\n[09:16] Ann: morning!\n[09:20] Tom: coffee?\n[09:21] Ann: sure"),
    ([(U, "Explain"), (A, "Step 1: mix\nStep 2: bake\nResult: cake"), (U, "thanks")], "Human: Explain\nAssistant: Step 1: mix\nStep 2: bake\nResult: cake\nHuman: thanks"),
    ([(U, "> quoted line\nwhat does it mean?"), (A, "It is a quote.")], "User: > quoted line\nwhat does it mean?\nAssistant: It is a quote."),
    ([(U, "hola"), (A, "buenas"), (U, "adiós")], "Usuario: hola\nAsistente: buenas\nUsuario: adiós"),
    ([(U, "Please translate:\nGuten Tag"), (A, "Good day")], "### Human:\nPlease translate:\nGuten Tag\n### Assistant:\nGood day"),
    ([(U, "What's up?"), (A, "Not much.\n\nYou?"), (U, "Same."), (A, "Good.")], "me: What's up?\nbot: Not much.\n\nYou?\nme: Same.\nbot: Good."),
    ([(U, "Is it open?"), (A, "Yes: 9-5"), (U, "Sunday too?"), (A, "No")], "> User: Is it open?\n> Assistant: Yes: 9-5\n> User: Sunday too?\n> Assistant: No"),
    ([(U, "hi all"), (A, "hi"), (U, "I'm late"), (A, "no problem"), (U, "thanks")], "Kim: hi all\nLee: hi\nPat: I'm late\nLee: no problem\nPat: thanks"),
    ([(U, "just some words without any speaker\nin two lines")], "just some words without any speaker\nin two lines"),
    ([(U, "Dear team: I write to ask"), (A, "Dear Jo: yes")], "<|user|>Dear team: I write to ask\n<|assistant|>Dear Jo: yes"),
]
