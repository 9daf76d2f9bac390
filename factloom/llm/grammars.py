"""The grammars of the languages that can be checked, and check(): does a whole text parse?"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from factloom.llm import scanners
from factloom.llm.peg import EOF, Grammar, compile_grammar
from factloom.sources import lexers

JSON = r"""
File = Value EOF
Value = Object / Array / STRING / NUMBER / WORD
Object = '{' (Pair (',' Pair)*)? '}'
Pair = STRING ':' Value
Array = '[' (Value (',' Value)*)? ']'
"""

#: Words that the Swift scanner tells apart and that are no plain names.
_SWIFT_HARD = "import class struct enum protocol extension func init deinit subscript var let typealias associatedtype operator precedencegroup if else guard switch case default for in while repeat do catch defer return throw throws rethrows try as is where break continue fallthrough self Self super nil true false inout public private internal fileprivate static Any _".split()
_SWIFT_SOFT = "actor macro async await some any each consume copy borrowing consuming sending isolated nonisolated open package final override mutating nonmutating lazy weak unowned required convenience dynamic optional indirect distributed prefix postfix infix get set willSet didSet yield discard unsafe of __owned __shared".split()
_SWIFT_SETS = {
    "ID": ["IDENT", *_SWIFT_SOFT],
    "NAME": ["IDENT", *_SWIFT_SOFT, *_SWIFT_HARD],
    "MODIFIER": "public private internal fileprivate open package static class final override mutating nonmutating lazy weak unowned required convenience dynamic optional indirect nonisolated isolated distributed prefix postfix infix borrowing consuming sending unsafe __owned __shared".split(),
    "TYPEWORD": "inout some any each repeat borrowing consuming sending isolated nonisolated __owned __shared".split(),
    "OPERATOR": ["BINARY", "PRE", "POST", "<", ">", "&", "AMP", "!", "?", "...", "="],
    "INFIX": ["BINARY", "AMP", "=", "->"],
    "DIRECTIVE": ["MACRO", "#file", "#line", "#function", "#column", "#available", "#unavailable", "#selector", "#keyPath", "#warning", "#error"],
    "LITERAL": ["NUMBER", "STRING", "REGEX", "nil", "true", "false"],
}

SWIFT = r"""
File = Statements EOF
Statements = ';'* (Statement (';'+ / Break))*
Break = NL / &'}' / &EOF / &'STRING_MORE' / &'STRING_CLOSE' / &'case' / &'default'
Statement = IfConfig / Declaration / Control / Expression
IfConfig = '#if' Statements ('#elseif' Statements)* ('#else' Statements)? '#endif'
Block = '{' Statements '}'

Declaration = Attributes Modifier* DeclarationBody
Attributes = (Attribute / '#if' Attributes ('#elseif' Attributes)* ('#else' Attributes)? '#endif' &(DeclarationStart))*
DeclarationStart = '@' / MODIFIER / 'func' / 'var' / 'let' / 'class' / 'struct' / 'enum' / 'actor' / 'protocol' / 'extension' / 'init' / 'subscript' / 'typealias' / 'import'
Attribute = '@' NAME ('.' NAME)* GenericArguments? (TIGHT Balanced)?
Balanced = '(' BalancedItem* ')'
BalancedItem = Balanced / '[' BalancedItem* ']' / '{' BalancedItem* '}' / !('(' / ')' / '[' / ']' / '{' / '}') ANY
Modifier = 'async' &('let' / 'var') / MODIFIER ('(' NAME ')')? &(MODIFIER / '@' / 'func' / 'var' / 'let' / 'class' / 'struct' / 'enum' / 'actor' / 'protocol' / 'extension' / 'init' / 'deinit' / 'subscript' / 'typealias' / 'associatedtype' / 'import' / 'operator' / 'precedencegroup' / 'case' / 'macro')
DeclarationBody = Import / Variable / Function / Type / Extension / Protocol / Initializer / Deinitializer / Subscript / Cases / Alias / Associated / OperatorDeclaration / Precedence / MacroDeclaration
Import = 'import' (('class' / 'struct' / 'enum' / 'protocol' / 'typealias' / 'func' / 'var' / 'let') &ID)? ID ('.' (NAME / OPERATOR))*
Variable = ('var' / 'let') Binding (',' Binding)*
Binding = Pattern Annotation? ('=' Expression)? (SL Accessors)? / Pattern Annotation? ('=' Expression)?
Annotation = ':' TypeName
Accessors = '{' Accessor+ '}' / Block
Accessor = Attribute* ('mutating' / 'nonmutating' / 'borrowing' / 'consuming' / '__consuming')? ('get' / 'set' / 'willSet' / 'didSet' / 'yield' / 'ACCESSOR') ('(' ID ')')? Effects Block? / '#if' Accessor* ('#elseif' Accessor*)* ('#else' Accessor*)? '#endif'
Function = FunctionHead Block
FunctionHead = 'func' (NAME / '>'+ 'BINARY'? / OPERATOR) GenericParameters? Parameters Effects Result? Where?
Result = '->' TypeName
Effects = ('async' / 'throws' ('(' TypeName ')')? / 'rethrows' / 'IDENT_REASYNC')*
Parameters = '(' (Parameter (',' Parameter)* ','?)? ')'
Parameter = Attribute* ('isolated' &NAME / 'nonisolated' &NAME)? NAME NAME? ':' TypeName '...'? ('=' Expression)?
GenericParameters = '<' GenericParameter (',' GenericParameter)* '>'
GenericParameter = Attribute* ('each' / 'let')? ID (':' TypeName)?
Where = 'where' Requirement (',' Requirement)*
Requirement = TypeName (':' / 'BINARY' / '==') TypeName
Type = ('class' / 'struct' / 'enum' / 'actor') ID GenericParameters? Inheritance? Where? Members
Inheritance = ':' Inherited (',' Inherited)*
Inherited = Attribute* ('PRE' / 'nonisolated')? TypeName
Members = '{' MemberList '}'
MemberList = ';'* (Member (';'+ / Break))*
Member = MemberConfig / Declaration / MacroExpansion
MemberConfig = '#if' MemberList ('#elseif' MemberList)* ('#else' MemberList)? '#endif'
Extension = 'extension' TypeName Inheritance? Where? Members
Protocol = 'protocol' ID ('<' ID (',' ID)* '>')? Inheritance? Where? '{' RequirementList '}'
RequirementList = ';'* (ProtocolMember (';'+ / Break))*
ProtocolMember = '#if' RequirementList ('#elseif' RequirementList)* ('#else' RequirementList)? '#endif' / Attributes Modifier* (FunctionHead Block? / InitializerHead Block? / Variable / SubscriptHead Accessors / Alias / Associated / Cases) / MacroExpansion
Initializer = InitializerHead Block
InitializerHead = 'init' ('?' / '!' / 'POST')? GenericParameters? Parameters Effects Where?
Deinitializer = 'deinit' Effects Block
Subscript = SubscriptHead Accessors
SubscriptHead = 'subscript' GenericParameters? Parameters Effects Result Where?
Cases = 'case' Case (',' Case)*
Case = ID ('(' (CaseParameter (',' CaseParameter)*)? ')')? ('=' Expression)?
CaseParameter = Attribute* (NAME NAME? ':')? TypeName ('=' Expression)?
Alias = 'typealias' ID GenericParameters? '=' TypeName Where?
Associated = 'associatedtype' ID Inheritance? ('=' TypeName)? Where?
OperatorDeclaration = 'operator' OPERATOR+ (':' ID (',' ID)*)? ('{' '}')?
Precedence = 'precedencegroup' ID '{' (NAME ':' (NAME ('.' NAME)*) (',' NAME)*)* '}'
MacroDeclaration = 'macro' ID GenericParameters? Parameters Effects Result? ('=' Expression)? Where?

TypeName = Attribute* TYPEWORD* ('PRE' &ID)? TypeCore
TypeCore = TypePostfix (('AMP' / '&') TypePostfix)*
TypePostfix = TypePrimary ('?' / '!' / 'POST' / '.' NAME GenericArguments? / '...' !('...'))*
TypePrimary = '(' (TupleElement (',' TupleElement)*)? ')' (Effects '->' TypeName)? / '[' TypeName (':' TypeName)? ']' / ('Any' / 'Self' / '_' / 'NUMBER') / ID GenericArguments?
TupleElement = (NAME NAME? ':')? TypeName '...'? ('=' Expression)?
GenericArguments = '<' (TypeName (',' TypeName)*)? '>'

Pattern = ('var' / 'let') Pattern / '(' (PatternElement (',' PatternElement)*)? ')' '?'? / '_' / ID / 'self'
PatternElement = (NAME ':')? Pattern

Control = If / Guard / For / While / Repeat / Switch / Do / Defer / Return / Throw / Jump / Labelled / YieldStatement
Labelled = ID ':' (If / For / While / Repeat / Switch / Do)
If = 'if' Conditions Block ('else' (If / Block))?
Guard = 'guard' Conditions 'else' Block
Conditions = Condition (',' Condition)*
Condition = 'case' ('is' TypeName / Binder? HeadExpression) Annotation? ('=' HeadExpression)? / ('let' / 'var') Pattern Annotation? ('=' HeadExpression)? / HeadExpression
For = 'for' 'try'? 'await'? ('case' ('is' TypeName / Binder? HeadExpression) / Pattern) Annotation? 'in' HeadExpression ('where' HeadExpression)? Block
While = 'while' Conditions Block
Repeat = 'repeat' Block 'while' Expression
Switch = 'switch' HeadExpression '{' SwitchItem* '}'
SwitchItem = '#if' SwitchItem* ('#elseif' SwitchItem*)* ('#else' SwitchItem*)? '#endif' / Label Statements
Label = Attribute* ('case' CaseItem (',' CaseItem)* ','? ':' / 'default' ':')
CaseItem = ('is' TypeName / Binder? Expression) ('where' Expression)?
Do = 'do' Effects Block ('catch' (!'{' CaseItem2 (',' CaseItem2)*)? Block)*
CaseItem2 = 'where' HeadExpression / ('is' TypeName / Binder? HeadExpression) ('where' HeadExpression)?
Defer = 'defer' Block
Return = 'return' (SL Expression / !Declaration !Control Expression)?
Throw = 'throw' Expression
Jump = ('break' / 'continue') (SL ID)? / 'fallthrough'
YieldStatement = ('yield' / 'discard') SL '&'? Expression

Expression = Effect* Unary (Infix)*
Effect = 'try' ('?' / '!')? / 'await' &(ExpressionStart) / 'unsafe' &('try' / 'await')
ExpressionStart = NAME / 'STRING' / 'STRING_OPEN' / 'NUMBER' / '(' / '[' / '.' / 'PRE' / '\\' / DIRECTIVE / '{' / '&' / '!'
Infix = INFIX Effect* Unary / ('<' / '>'+) Effect* Unary / '...' Effect* Unary / 'TERNARY' Expression ':' Effect* Expression / 'is' TypeName / 'as' ('?' / '!')? TypeName / ('async' / 'throws') '->' Unary
Unary = ('PRE' / '&' / '!' / '...')* Word* Postfix
Binder = ('let' / 'var') &(ID / '(' / '_' / '.' / '[')
Word = ('consume' / 'copy' / 'each' / 'any' / 'some' / 'unsafe' / 'repeat') &(NAME / '(' / '_' / '.' / '[')
Postfix = Primary Suffix*
Suffix = '.' Member2 / '?' / '!' / 'POST' / '...' &(')' / ']' / ',' / '}' / ':' / NL) / SL '(' Arguments ')' / SL '[' Arguments ']' / SL Trailing / PostfixConfig
Member2 = (NAME / 'NUMBER') GenericUse? ArgumentNames?
ArgumentNames = '(' (NAME ':')+ ')'
PostfixConfig = '#if' (&'.' Suffix+)? ('#elseif' (&'.' Suffix+)?)* ('#else' (&'.' Suffix+)?)? '#endif'
Trailing = Closure (NAME ':' Closure)*
GenericUse = GenericArguments &(GenericFollow)
GenericFollow = '(' / ')' / ']' / '}' / '{' / '[' / '.' / ',' / ';' / ':' / '?' / '!' / EOF / '=' / 'AMP' / 'BINARY' / 'POST' / NL
Primary = Literal / Closure / ('self' / 'Self' / 'super' / '_' / 'Any' / 'init') / If / Switch / Do / ID GenericUse? ArgumentNames? / Parenthesis / List / '.' Member2 / KeyPath / MacroExpansion / 'class' &'.'
Literal = LITERAL / 'STRING_OPEN' InterpolationBody ('STRING_MORE' InterpolationBody)* 'STRING_CLOSE'
InterpolationBody = Arguments
Parenthesis = '(' Arguments ')'
List = '[' ']' / '[' ':' ']' / '[' Element (',' Element)* ','? ']'
Element = Expression (':' Expression)?
Arguments = (Argument (',' Argument)* ','?)?
Argument = (NAME ':')? (OPERATOR &(',' / ')' / ']') / Binder? Expression / TypeName)
KeyPath = '\\' (TypePrimary / ) KeyStep*
KeyStep = '.' (NAME GenericArguments? ArgumentNames? / '[' Arguments ']' / '?' / '!') / '[' Arguments ']' / '?' / '!' / 'POST' / SL '(' Arguments ')'
MacroExpansion = Attributes Modifier* DIRECTIVE (SL GenericArguments)? (SL '(' Arguments ')')? (SL Trailing)?
Closure = '{' Signature? Statements '}'
Signature = Attribute* Captures? (Parameters2 / (ID / '_') (',' (ID / '_'))*)? Effects Result? 'in'
Captures = '[' (Capture (',' Capture)*)? ']'
Capture = (('weak' / 'unowned') ('(' NAME ')')?)? ('self' / ID) ('=' Expression)?
Parameters2 = '(' (Parameter2 (',' Parameter2)* ','?)? ')'
Parameter2 = Attribute* NAME NAME? (':' TypeName '...'?)?

HeadExpression = Effect* HeadUnary (HeadInfix)*
HeadInfix = INFIX Effect* HeadUnary / ('<' / '>'+) Effect* HeadUnary / '...' Effect* HeadUnary / 'TERNARY' HeadExpression ':' Effect* HeadExpression / 'is' TypeName / 'as' ('?' / '!')? TypeName
HeadUnary = ('PRE' / '&' / '!' / '...')* Word* HeadPostfix
HeadPostfix = HeadPrimary HeadSuffix*
HeadSuffix = '.' Member2 / '?' / '!' / 'POST' / '...' &('{' / ')') / SL '(' Arguments ')' / SL '[' Arguments ']'
HeadPrimary = Literal / ('self' / 'Self' / 'super' / '_' / 'Any') / ID GenericUse? ArgumentNames? / Parenthesis / List / '.' Member2 / KeyPath / HeadMacro
HeadMacro = ('#available' / '#unavailable') Balanced / DIRECTIVE (SL '(' Arguments ')')?
"""

PYTHON = r"""
File = (Statement / NEWLINE)* EOF
Statement = Compound / Simple
Simple = Small (';' Small)* ';'? NEWLINE
Small = Import / From / 'pass' / 'break' / 'continue' / Return / Raise / Global / Del / Assert / TypeAlias / Assignment
Import = 'import' Dotted ('as' NAME)? (',' Dotted ('as' NAME)?)*
Dotted = NAME ('.' NAME)*
From = 'from' ('.' / '...')* Dotted? 'import' ('*' / '(' Names ','? ')' / Names)
Names = NAME ('as' NAME)? (',' NAME ('as' NAME)?)*
Return = 'return' Stars?
Raise = 'raise' (Test ('from' Test)?)?
Global = ('global' / 'nonlocal') NAME (',' NAME)*
Del = 'del' Stars
Assert = 'assert' Test (',' Test)?
TypeAlias = 'type' NAME TypeParameters? '=' Test
Assignment = Stars (':' Test ('=' (Yield / Stars))? / AUGMENT (Yield / Stars) / ('=' (Yield / Stars))+)? / Yield
Compound = If / While / For / Try / With / Decorated / Definition / Class / Async / Match
Block = NEWLINE INDENT (Statement / NEWLINE)+ DEDENT / Simple
If = 'if' Named ':' Block ('elif' Named ':' Block)* ('else' ':' Block)?
While = 'while' Named ':' Block ('else' ':' Block)?
For = 'for' Targets 'in' Stars ':' Block ('else' ':' Block)?
Targets = Target (',' Target)* ','?
Target = '*'? Or2
Try = 'try' ':' Block (('except' '*'? (Stars ('as' NAME)?)? ':' Block)+ ('else' ':' Block)? ('finally' ':' Block)? / 'finally' ':' Block)
With = 'with' ('(' WithItem (',' WithItem)* ','? ')' ':' / WithItem (',' WithItem)* ':') Block
WithItem = Test ('as' Target)?
Decorated = ('@' Named NEWLINE)+ (Definition / Class / Async)
Definition = 'def' NAME TypeParameters? '(' Parameters? ')' ('->' Test)? ':' Block
TypeParameters = '[' TypeParameter (',' TypeParameter)* ','? ']'
TypeParameter = ('*' / '**')? NAME (':' Test)? ('=' Test)?
Parameters = Parameter (',' Parameter)* ','?
Parameter = '/' / '**' NAME (':' Test)? / '*' (NAME (':' '*'? Test)?)? / NAME (':' Test)? ('=' Test)?
Class = 'class' NAME TypeParameters? ('(' Arguments? ')')? ':' Block
Async = 'async' (Definition / With / For)
Match = 'match' Stars ':' NEWLINE INDENT ('case' Stars ('if' Named)? ':' Block)+ DEDENT
Yield = 'yield' ('from' Test / Stars)?
Stars = Star (',' Star)* ','?
Star = '*' Or2 / Named
Named = Name ':=' Test / Test
Name = NAME
Test = Lambda / Or ('if' Or 'else' Test)?
Lambda = 'lambda' LambdaParameters? ':' Test
LambdaParameters = LambdaParameter (',' LambdaParameter)* ','?
LambdaParameter = '/' / '**' NAME / '*' NAME? / NAME ('=' Test)?
Or = And ('or' And)*
And = Not ('and' Not)*
Not = 'not' Not / Comparison
Comparison = Or2 (('<' / '>' / '==' / '>=' / '<=' / '!=' / 'not' 'in' / 'in' / 'is' 'not' / 'is') Or2)*
Or2 = Xor ('|' Xor)*
Xor = And2 ('^' And2)*
And2 = Shift ('&' Shift)*
Shift = Sum (('<<' / '>>') Sum)*
Sum = Term (('+' / '-') Term)*
Term = Factor (('*' / '/' / '//' / '%' / '@') Factor)*
Factor = ('+' / '-' / '~') Factor / Power
Power = 'await'? Primary ('**' Factor)?
Primary = Atom ('.' NAME / '(' Arguments? ')' / '[' Slices ']')*
Slices = Slice (',' Slice)* ','?
Slice = Test? ':' Test? (':' Test?)? / '*' Or2 / Named
Arguments = Argument (',' Argument)* ','?
Argument = '**' Test / '*' Test / NAME '=' Test / Named Comprehension?
Comprehension = ('async'? 'for' Targets 'in' Or ('if' CompIf)*)+
CompIf = Name ':=' Or / Or / Lambda
Atom = STRING+ / NUMBER / NAME / 'None' / 'True' / 'False' / '...' / '(' (Yield / Star Comprehension / Stars)? ')' / '[' (Star Comprehension / Stars)? ']' / '{' (DictItem Comprehension / DictItem (',' DictItem)* ','? / Star Comprehension / Stars)? '}'
DictItem = '**' Or2 / Test ':' Test
"""
_PY_WORDS = "import from pass break continue return raise global nonlocal del assert if elif else while for in try except finally with as def class async await yield lambda or and not is None True False".split()
_PY_SETS = {"AUGMENT": ["+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="], "NAME": ["NAME", "match", "case", "type"]}

C = r"""
File = (External / ';')* EOF
External = MACROID BalancedGroup? ';'? &(NL / EOF) / 'extern' STRING '{' External* '}' / 'extern' STRING External / StaticAssert / Function / Declaration / MacroCall
MacroCall = MACROID BalancedGroup ';'? / NAME BalancedGroup (';' / &'{')
MacroStatement = MACROID BalancedGroup ';'? / NAME BalancedGroup &'{'
BalancedItem = '(' BalancedItem* ')' / '[' BalancedItem* ']' / '{' BalancedItem* '}' / !('(' / ')' / '[' / ']' / '{' / '}') ANY
BalancedGroup = '(' BalancedItem* ')'
StaticAssert = ('_Static_assert' / 'static_assert') '(' Assign (',' STRING)? ')' ';'
Function = Specifiers Declarator Declaration* Compound
Declaration = Specifiers (InitDeclarator (',' InitDeclarator)*)? After* ';'
Attribute = ('__attribute__' / '__attribute' / '__declspec' / '_Alignas' / 'alignas' / '__asm__' / 'asm') '(' BalancedItem* ')' / '[' '[' BalancedItem* ']' ']'
After = Attribute / MACROID BalancedGroup? &(';' / ',' / '{' / ')' / '=' / MACROID / '__attribute__' / '__asm__' / 'asm')
Specifiers = Qualifier* (TypeSpecifier Qualifier* (BASIC Qualifier*)* / BASIC Qualifier* (BASIC / Qualifier)*)
Qualifier = QUALIFIER / Attribute / NAME &(NAME NAME) / NAME &(BASIC / 'struct' / 'union' / 'enum' / QUALIFIER) / MACROID BalancedGroup &(NAME / BASIC / 'struct' / 'union' / 'enum' / QUALIFIER)
TypeSpecifier = Record / Enum / ('typeof' / '__typeof__' / '_Atomic') '(' BalancedItem* ')' / NAME
Record = ('struct' / 'union') Attribute* (NAME? '{' (Field / ';')* '}' / NAME) Attribute*
Field = StaticAssert / Specifiers (FieldDeclarator (',' FieldDeclarator)*)? Attribute* ';'
FieldDeclarator = ':' Conditional / Declarator (':' Conditional)?
Enum = 'enum' Attribute* (NAME? (':' Specifiers)? '{' Enumerator (',' Enumerator)* ','? '}' / NAME)
Enumerator = NAME (MACROID BalancedGroup? / Attribute)* ('=' Conditional)?
InitDeclarator = Declarator After* ('=' Initializer)?
Declarator = Pointer* Direct
Pointer = ('*' / '^') (QUALIFIER / Attribute / NAME &(NAME / '*'))*
Direct = (MACROID BalancedGroup &(NAME / '(') / ) (NAME / '(' (Attribute / NAME &('*' / NAME))* Declarator ')') DirectSuffix*
DirectSuffix = '(' Parameters? ')' After* / '[' (QUALIFIER* (Assign / '*')?)? ']'
Parameters = Parameter (',' Parameter)* (',' '...')? / NAME (',' NAME)*
Parameter = Specifiers (Declarator / Abstract)? Attribute* / '...'
Abstract = Pointer+ AbstractDirect? / AbstractDirect
AbstractDirect = ('(' Abstract ')' / '(' Parameters? ')' / '[' QUALIFIER* (Assign / '*')? ']')+
TypeName = Specifiers Abstract?
Initializer = '{' (Designated (',' Designated)* ','?)? '}' / Assign
Designated = (('[' Conditional ('...' Conditional)? ']' / '.' NAME)+ '=')? Initializer
Compound = '{' (Declaration / Statement)* '}'
Statement = Labelled / Compound / If / Switch / While / Do / For / Jump / StaticAssert / ExpressionStatement / MacroStatement
Labelled = NAME ':' / 'case' Conditional ('...' Conditional)? ':' / 'default' ':'
If = 'if' '(' Expression ')' Statement ('else' Statement)?
Switch = 'switch' '(' Expression ')' Statement
While = 'while' '(' Expression ')' Statement
Do = 'do' Statement 'while' '(' Expression ')' ';'
For = 'for' '(' (Declaration / Expression? ';') Expression? ';' Expression? ')' Statement
Jump = 'goto' NAME ';' / ('break' / 'continue') ';' / 'return' Expression? ';'
ExpressionStatement = Expression? ';'
Expression = Assign (',' Assign)*
Assign = Conditional (ASSIGN Assign)?
Conditional = LogicalOr ('?' Expression? ':' Conditional)?
LogicalOr = Cast (BINARY Cast)*
Cast = '(' TypeName ')' ('{' (Designated (',' Designated)* ','?)? '}' PostfixTail* / Cast) / Unary
Unary = ('++' / '--') Unary / UNARY Cast / ('sizeof' / '_Alignof' / 'alignof') ('(' TypeName ')' / Unary) / Postfix
Postfix = Primary PostfixTail*
PostfixTail = '[' Expression ']' / '(' (Argument (',' Argument)*)? ')' / '.' NAME / '->' NAME / '++' / '--'
Argument = Assign / TypeName
Primary = (STRING / NAME &STRING)+ NAME? / NUMBER / NAME / '(' Compound ')' / '(' Expression ')' / '_Generic' '(' BalancedItem* ')'
"""
_C_SETS = {
    "NAME": ["NAME", "MACROID"],
    "BASIC": "void char short int long float double signed unsigned _Bool bool _Complex __int128".split(),
    "QUALIFIER": "const volatile restrict __restrict __restrict__ static extern typedef register auto inline __inline __inline__ _Noreturn _Thread_local thread_local __thread constexpr __extension__".split(),
    "ASSIGN": ["=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="],
    "BINARY": ["||", "&&", "|", "^", "&", "==", "!=", "<", ">", "<=", ">=", "<<", ">>", "+", "-", "*", "/", "%"],
    "UNARY": ["&", "*", "+", "-", "~", "!"],
}


def _with_any(name: str, text: str, sets: dict[str, list[str]], more: list[str]) -> Grammar:
    """ANY stands for each token there is; a first pass gathers them."""
    sets = {**sets, "ANY": list(more)}
    known = compile_grammar(name, text, sets).kinds
    return compile_grammar(name, text, {**sets, "ANY": [k for k in known if k not in (EOF, "ANY") and k not in sets] + list(more)})


_MORE_SWIFT = ["IDENT", "NUMBER", "STRING", "STRING_OPEN", "STRING_MORE", "STRING_CLOSE", "REGEX", "MACRO", "POST", "PRE", "BINARY", "TERNARY", "AMP", "...", ".", ";", "\\", "@", "`", *_SWIFT_SOFT, *_SWIFT_HARD, "#if", "#elseif", "#else", "#endif"]
#: How token classes and rules are named in messages; what is not named here is a literal or a rule's own name.
_SAID = {
    "Expression": "an expression", "HeadExpression": "an expression", "Unary": "an expression", "HeadUnary": "an expression", "Postfix": "an expression", "HeadPostfix": "an expression", "Primary": "an expression", "HeadPrimary": "an expression", "Test": "an expression", "Stars": "an expression",
    "Named": "an expression", "Or2": "an expression", "Or": "an expression", "Assign": "an expression", "Conditional": "an expression", "Cast": "an expression", "Statement": "a statement", "Declaration": "a declaration", "DeclarationBody": "a declaration", "Member": "a declaration", "External": "a declaration",
    "TypeName": "a type", "TypeCore": "a type", "TypePrimary": "a type", "Pattern": "a pattern", "Block": "a block", "Compound": "a block", "Closure": "a closure", "Value": "a value", "STRING": "a string", "NUMBER": "a number", "IDENT": "a name", "NAME": "a name", "ID": "a name", "NEWLINE": "the end of the line",
    "EOF": "the end of the file", "INDENT": "an indented block", "DEDENT": "the end of the block", "NL": "a new line", "Declarator": "a declarator", "Specifiers": "a type", "Parameters": "parameters", "Members": "a body in braces", "Name": "a name", "WORD": "true, false or null", "ASSIGN": "=", "BASIC": "a type", "QUALIFIER": "a qualifier", "OPERATOR": "an operator", "LITERAL": "a literal", "MODIFIER": "a modifier", "DIRECTIVE": "a macro", "TYPEWORD": "a type", "AUGMENT": "an assignment", "Pair": "a name in quotes",
}
_UNSAID = {"SL", "TIGHT", "POST", "PRE", "BINARY", "AMP", "TERNARY", "MACRO", "MACROID", "INFIX", "ANY", "Attribute", "Attributes", "Modifier", "GenericUse", "PostfixConfig", "Suffix", "HeadSuffix", "Infix", "HeadInfix", "Trailing", "ArgumentNames", "Effects", "Effect", "STRING_MORE", "STRING_CLOSE", "Break", "IfConfig", "MemberConfig", "DirectSuffix", "PostfixTail", "After", "#if", "?", "!", "...", ".", "="}
_made: dict[str, tuple[Grammar, object]] = {}


def grammar(lang: str) -> tuple[Grammar, object] | None:
    """The compiled grammar and scanner of a language, made once in each process; None if there is none."""
    if lang not in _made:
        if lang == "json":
            _made[lang] = compile_grammar(lang, JSON), scanners.json_tokens
        elif lang == "swift":
            _made[lang] = _with_any(lang, SWIFT, _SWIFT_SETS, _MORE_SWIFT), lexers.swift_tokens
        elif lang == "python":
            _made[lang] = compile_grammar(lang, PYTHON, {**_PY_SETS, "WORDS": _PY_WORDS}), scanners.python_tokens
        elif lang == "c":
            _made[lang] = _with_any(lang, C, _C_SETS, ["NAME", "MACROID", "NUMBER", "STRING", *[x for v in _C_SETS.values() for x in v], ";", ",", ".", "->", "...", "=", ":", "?"]), scanners.c_tokens
        else:
            return None
    return _made[lang]


@dataclass(frozen=True)
class Fault:
    offset: int
    line: int
    col: int
    message: str
    cause: str  # conflict, truncated, wrong_language or syntax


LANGUAGES = ("swift", "json", "python", "c")


def scan(text: str, lang: str) -> lexers.Tokens | None:
    found = grammar(lang)
    return found[1](text, found[0].kinds) if found else None


#: Frames of the parser's functions: a text may nest as deep as this allows, some hundred thousand brackets.
DEPTH = 3_000_000
_CUT = (lexers.OPEN_STRING, lexers.OPEN_COMMENT)


def _deep() -> None:
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)


def valid_tokens(text: str, lang: str) -> lexers.Tokens | None:
    """The tokens of a text that parses as a whole, else None; the text is scanned once."""
    g, scanner = grammar(lang)
    _deep()
    t = scanner(text, g.kinds)
    return None if t.errors or g.parse(t.kinds, t.first) >= 0 else t


def _variants(text: str, lang: str, scanner, kinds: dict[str, int]):
    """The token streams that all must parse: one, or in C one for each branch of the conditions."""
    yield scanner(text, kinds)
    if lang == "c":
        for k in range(1, scanners.c_branches(text)):
            yield scanner(text, kinds, k)


def parses(text: str, lang: str) -> bool:
    g, scanner = grammar(lang)
    _deep()
    return all(not t.errors and g.parse(t.kinds, t.first) < 0 for t in _variants(text, lang, scanner, g.kinds))


def _message(g: Grammar, t: lexers.Tokens, far: int) -> str:
    """What the grammar would have taken at the furthest token."""
    wanted = g.expected(t.kinds, t.first, far)
    # What ends something is most often what was forgotten.
    said = sorted({_SAID.get(w, w) for w in wanted if w not in _UNSAID}, key=lambda w: (w not in (";", ")", "]", "}", ",", ":"), not w[:1].isalpha(), w))
    if not said:
        return "a declaration was expected here"
    return ("expected " + (said[0] if len(said) == 1 else ", ".join(said[:-1]) + " or " + said[-1])) if len(said) <= 6 else "expected " + ", ".join(said[:5]) + " or another token"


def _fault(text: str, lang: str) -> tuple[int, str, str] | None:
    g, scanner = grammar(lang)
    for t in _variants(text, lang, scanner, g.kinds):
        far = g.parse(t.kinds, t.first)
        if far < 0 and not t.errors:
            continue
        far = min(far, len(t.kinds) - 1) if far >= 0 else min(t.errors)
        if lexers.MARKER in t.errors.values():
            far, message = next((k, m) for k, m in t.errors.items() if m == lexers.MARKER)
            return t.starts[far], message, "conflict"
        if message := t.errors.get(far, ""):
            cut = message in _CUT or t.starts[far] >= len(text.rstrip())
            return t.starts[far], message, "truncated" if cut else "syntax"
        message = _message(g, t, far)
        if t.kinds[far] == 0:
            return t.starts[far], f"the file ends too early: {message}", "truncated"
        return t.starts[far], message, "syntax"
    return None


def check(text: str | None, lang: str | None) -> Fault | None:
    """None if the whole text parses (or its language has no grammar, or it is null); else where and why it doesn't.

    The furthest token that fits nothing is the place, and what the grammar would have taken there the message. The
    cause is conflict if a merge marker stands outside strings and comments, truncated if the text ends too early,
    wrong_language if it parses as another language, else syntax. An empty text is a valid file of every language but
    JSON. A text that nests beyond DEPTH, which no real file does, is said to nest too deeply.
    """
    lang = (lang or "").strip().lower()
    if text is None or grammar(lang) is None:
        return None
    _deep()
    try:
        found = _fault(text, lang)
    except RecursionError:
        found = (0, "nested too deeply", "syntax")
    if found is None:
        return None
    at, message, cause = found
    if cause != "conflict" and text.strip() and any(other != lang and _likely(text, other) for other in LANGUAGES):
        cause = "wrong_language"
    line, col = lexers.Places(text)(at)
    return Fault(at, line, col, message, cause)


def _likely(text: str, lang: str) -> bool:
    """Whether a text parses as another language; one that cannot begin a value is no JSON without parsing it."""
    if lang == "json" and text.lstrip("\ufeff \t\r\n")[:1] not in ("{", "[", '"'):
        return False
    try:
        return parses(text, lang)
    except RecursionError:
        return False
