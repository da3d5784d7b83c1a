"""Table shapes. Sentences are the unit of extraction: tokens and mentions are nested, so no operator on a sentence shuffles."""

TOKEN = "struct<i:int,idx:int,text:string,lemma:string,pos:string,dep:string,head:int,is_stop:boolean,is_punct:boolean>"
MENTION = "struct<start:int,end:int,root:int,text:string,label:string>"
CHUNK = "struct<start:int,text:string,lemma:string>"
#: i, head, start, end and root count from 0 in the sentence; a root token is its own head; idx is the place in the document
SENTENCES = f"doc_id string, sent_id int, sentence string, tokens array<{TOKEN}>, mentions array<{MENTION}>, chunks array<{CHUNK}>"
PAIRS = "doc_id string, sent_id int, seq long, entity1 string, type1 string, entity2 string, type2 string, context string, sentence string, confidence double"
PROPOSITIONS = "doc_id string, seq long, arg1 string, type1 string, arg2 string, type2 string, path string, negated boolean, sentence string"
RELATIONS = "seq long, subject string, relation string, object string, confidence double, source string, evidence string"
LABELS = "key string, label string, source string, entity1 string, entity2 string, type1 string, type2 string, context string, frame_agreement string, confidence double"
